import random

from tickloom.llm.truncation import truncated, truncation_rates, trie

SCHEMA = "doc_id long, source string, text string, ending string, token string"
WORDS = "the late mill reported every idle farmer beside this considerable widow carried magistrate under doubtful orchard".split()


def page(rng, n):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(n))


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        text = page(rng, rng.randrange(4, 40))
        if i % 4 == 0:
            source, limit = "short", 600
            if len(text) > limit:
                text = text[:limit]
                if not text.endswith("."):  # a text that closes does not stop inside a sentence
                    cut = cut | {i}
        elif i % 4 == 1:
            source = "free"
            text += rng.choice(["", "\nContinued on Page 4", "\n* * *", "\nH. Orchard", " ", "..."])
        else:
            source = "wire"
            if i % 20 == 2:
                text, cut = text[: len(text) // 2].rstrip(" .\n") + " doub", cut | {i}
        docs.append((i, source, text))
    return docs, cut


def found(spark, docs):
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA)
    return df, truncated(df, "doc_id", "source", "text")


def test_cut_texts_are_found(spark):
    docs, cut = corpus()
    df, out = found(spark, docs)
    assert {r["doc_id"] for r in out.collect()} == cut
    rates = {r["source"]: r for r in truncation_rates(df, out, "source").collect()}
    assert rates["free"]["n_cut"] == 0 and rates["short"]["n_cut"] == sum(i % 4 == 0 for i in cut)
    assert abs(rates["wire"]["rate"] - rates["wire"]["n_cut"] / rates["wire"]["n_docs"]) < 1e-12


def test_nulls_empty_and_repeated(spark):
    docs, cut = corpus()
    more = [(1000, None, docs[1][2] + " doubt"), (1001, "wire", None), (1002, "wire", ""), (1003, "wire", " \n "), (1004, "wire", "x" * 100_000 + ".")]
    twice = docs[min(cut)]
    _, out = found(spark, docs + more + [twice])
    ids = sorted(r["doc_id"] for r in out.collect())
    assert set(ids) == cut | {1000} and ids.count(twice[0]) == 2


def test_texts_without_a_source_are_held_against_all_limits(spark):
    docs, cut = corpus()
    whole = page(random.Random(9), 40).replace("\n", " ")
    closed = whole[:598].rsplit(" ", 1)[0].rstrip(".")
    more = [
        (1000, None, whole[:592] + " xqzt..."), (1001, None, whole[:594] + " xqzt…"), (1002, None, whole[:596] + " 17%"), (1003, None, whole[:599] + ","),
        (1004, None, closed + "m" * (599 - len(closed)) + "."), (1005, None, closed + "m" * (598 - len(closed)) + ".»"), (1006, None, closed + " 17%"),
    ]
    assert [len(t) for _, _, t in more[:6]] == [600] * 6 and len(more[6][2]) != 600
    _, out = found(spark, docs + more)
    assert {r["doc_id"]: r["evidence"] for r in out.where("doc_id >= 1000").collect()} == {i: "limit" for i in (1000, 1001, 1002, 1003)}


def test_a_broken_word_before_an_ellipsis_is_found(spark):
    docs, cut = corpus()
    more = [(1000 + i, s, docs[1][2] + end) for i, (s, end) in enumerate([("free", " doub..."), (None, " doub…"), ("free", " doubtful..."), (None, " xqzt..."), (None, " 17...")])]
    _, out = found(spark, docs + more)
    assert {r["doc_id"]: r["evidence"] for r in out.where("doc_id >= 1000").collect()} == {1000: "word", 1001: "word"}


def test_no_documents(spark):
    df, out = found(spark, [])
    assert out.count() == 0 and truncation_rates(df, out, "source").count() == 0


def test_trie_has_the_nodes_that_tokens_lead_to(spark):
    words = spark.createDataFrame([("ab",), ("abc",), ("b",), ("z" * 30_000,)], "word string")
    nodes = lambda *tokens: {r["prefix"]: (r["is_word"], r["goes_on"]) for r in trie(words, spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    assert nodes("a", "ab", "abc", "b", "b", None, "abcd", "x") == {"a": (False, True), "ab": (True, True), "abc": (True, False), "b": (True, False)}
    assert nodes("zz") == {"zz": (False, True)}
    assert nodes() == {}


def test_the_trie_decides(spark):
    docs, cut = corpus()
    df, _ = found(spark, docs)
    wire = {i for i in cut if i % 4 == 2}
    without = {r["doc_id"] for r in truncated(df, "doc_id", "source", "text", known_from=10**9).collect()}
    assert wire and cut - without == wire
    more = [(1000, "wire", docs[2][2] + " widow"), (1001, "wire", docs[2][2] + " Xqztal"), (1002, "wire", docs[2][2] + " consid"), (1003, "wire", docs[2][2] + "\nH. Orch")]
    _, out = found(spark, docs + more)
    assert {r["doc_id"]: r["evidence"] for r in out.where("doc_id >= 1000").collect()} == {1000: "sentence", 1002: "word", 1003: "word"}


def test_a_text_that_closes_at_the_limit_is_whole(spark):
    docs, cut = corpus()
    text = docs[min(cut)][2][:590].rstrip()
    more = [(1000, "short", text + "m" * (599 - len(text)) + "."), (1001, "short", text + "m" * (600 - len(text)))]
    _, out = found(spark, docs + more)
    assert {r["doc_id"] for r in out.where("doc_id >= 1000").collect()} == {1001}


def test_long_lines_are_read_whole(spark):
    docs, _ = corpus()
    line = " ".join(WORDS * 200)
    runs = ["A" * 200_000 + "b", "a" * 200_000, "1" + " " * 200_000 + "x" * 200_000 + ".", "a9" * 100_000 + " "]
    more = [(1000, "wire", "H. " + line), (1001, "wire", line + " consid"), *((2000 + i, "wire", t) for i, t in enumerate(runs))]
    _, out = found(spark, docs + more)
    assert {r["doc_id"]: r["evidence"] for r in out.where("doc_id >= 1000").collect()} == {1000: "sentence", 1001: "word"}
