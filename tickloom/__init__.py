"""tickloom: lazy DataFrame operators over event tapes, written for Catalyst and adaptive execution."""
