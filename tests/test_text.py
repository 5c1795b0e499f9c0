from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.functions import words
from folioscan.queries import QUERIES


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


def test_words():
    assert words.tokenize("音楽 ab音 cd") == ["音", "楽", "ab音", "cd"]
    assert words.tokenize("") == [] and words.normalize(None) == "" and words.normalize("ÉcolE") == "ecole" and words.normalize("É", False) == "é"
    assert words.stem("running") == "run" and words.stem("cat") == "cat" and words.stem("run*") == "run*" and words.stem("jumping") == "jump"
    assert words.index_keys("jumping") == ["jumping", "jump"] and words.index_keys("cat") == ["cat"] and words.index_keys("") == []
    assert words.clean_extracted("spec-\ntral  x\r\n\n\n\ny") == "spectral x\n\ny" and words.clean_extracted(None) == ""
    assert words.clean_display("café ​x­\ny") == "café xy"


def test_columns_equal_words(spark):
    texts = ["", "Ab ção 音楽x y_1 ²", "İstanbul ﬁ", "a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for t, r in zip(texts, df.select("x", T.fold("x").alias("f"), T.tokenize(T.fold("x")).alias("t")).collect()):
        assert r.f == (None if t is None else words.normalize(t))
        assert r.t == words.tokenize(words.normalize(t))


def test_jvm_equals_python(spark):
    """ASCII texts stay in the JVM; they come out as the others do."""
    texts = ["spec-\ntral  x\r\n\n\n\ny\x1c", "a-\nb-\nc \t d\r", "A-\x1f\n B", "-\nitem\n\n\n", "é-\nb  c\n\n\n\nd", "  ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", T.clean_extracted("x").alias("c"), T.clean_display("x").alias("d"), T.fold("x").alias("f")).collect():
        if r.x is None:
            assert r.c is None and r.d is None and r.f is None
        else:
            assert (r.c, r.d, r.f) == (words.clean_extracted(r.x), words.clean_display(r.x), words.normalize(r.x)), repr(r.x)
    lists = spark.createDataFrame([(1, ["running", "cats", None]), (2, []), (3, None), (4, ["running"])], "k int, w array<string>")
    assert {r.k: r.s for r in lists.select("k", T.stems("w").alias("s")).collect()} == {1: ["run", words.stem("cats"), None], 2: [], 3: None, 4: ["run"]}


def test_small_functions(spark):
    assert one(spark, "/a/b/Book.FB2.ZIP", T.extension("x")) == ".fb2.zip" and one(spark, "/a.b/c", T.extension("x")) == ""
    assert one(spark, ".pdf", T.type_of("x")) == "pdf" and one(spark, ".exe", T.type_of("x")) is None
    assert one(spark, "a-b c/d -e", T.hyphen_variant("x")) == "a b c d -e"
    assert one(spark, "p 12 of 345", T.mask_digits("x")) == "p # of #"
    assert one(spark, "<p>a<script>x</p></script> b</p>", T.strip_tags("x")) == "a b"
    assert one(spark, "a;b;c,d", T.delimiter_of("x")) == ";" and one(spark, "a,b;c", T.delimiter_of("x")) == "," and one(spark, None, T.delimiter_of("x")) == ","
    assert one(spark, "/x/a:b*", T.safe_name("x")) == "a_b_" and one(spark, "///", T.safe_name("x")) == "root" and one(spark, None, T.safe_name("x")) == "root"
    assert one(spark, "a<b & 'c'", T.html_escape("x")) == "a&lt;b &amp; &#x27;c&#x27;"
    assert one(spark, ".csv", T.position_label("x")) == "Location"


def test_quality(spark):
    assert one(spark, None, T.is_garbage("x")) and one(spark, "ab " * 40, T.is_garbage("x")) and one(spark, "1 2 3 " * 40, T.is_poor("x"))
    good = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(30))
    assert not one(spark, good, T.is_garbage("x")) and not one(spark, good, T.is_poor("x"))
    assert one(spark, "", F.round(T.page_score("x"), 3)) == 0


def test_display_of_all_texts(spark, tmp_path):
    texts = {
        1: "spec-\ntral line", 2: "spec- \r\n  tral", 3: "co\u00ad\n  operate co\u00adop", 4: "a.\n\n\n\nb", 5: "a \t b\r\n\r\n\r\nc", 6: "-\nitem", 7: "caf\u0065\u0301 x\u200b\u00ady-\nz\n\n\n", 8: "plain", 9: "",
        10: None,
    }
    shown = {1: "spectral line", 2: "spectral", 3: "cooperate coop", 4: "a.\n\nb", 5: "a b\n\nc", 6: "-\nitem", 7: "café xyz", 8: "plain", 9: ""}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.shown for r in QUERIES["display_text"](spark, str(tmp_path)).collect()} == shown
