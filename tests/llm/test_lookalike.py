import unicodedata

from folioscan.llm import lookalike as lo

PLAIN = lo.choose(lo.find_classes(), {})


def kinds(text):
    return PLAIN.rewrite(text)[1]


def test_forms():
    assert PLAIN.rewrite("Ｆｏｌｄｅｒ ２， ﬁn") == ("Folder 2, fin", ["form"])
    assert PLAIN.rewrite("café ệ") == ("café " + unicodedata.normalize("NFC", "ệ"), ["accent"])
    assert PLAIN.rewrite("a b c　d") == ("a b c d", ["blank"])
    assert PLAIN.rewrite("no­te ​x﻿") == ("note x", ["invisible"])
    assert PLAIN.rewrite("piеces оf Cоver") == ("pieces of Cover", ["letter"])
    assert PLAIN.rewrite("9311 ріесеѕ of pump") == ("9311 pieces of pump", ["letter"])
    assert PLAIN.rewrite("нoвый pump") == ("новый pump", ["letter"]) and PLAIN.rewrite("πρoσβαση") == ("προσβαση", ["letter"])
    assert PLAIN.rewrite("x́ y")[1] == ["accent"]
    assert PLAIN.rewrite("օne of them") == ("one of them", ["letter"]) and PLAIN.rewrite("Ꭺpple") == ("Apple", ["letter"])
    assert PLAIN.rewrite("￥5 ￠") == ("¥5 ¢", ["form"])


def test_no_cases():
    for text in ("Привет, а с ним и Pobes", "С 01.02 табличка", "άλφα ο βήτα", "2.ª nº 5 “x” – 17 °C …", "naïve café ß œ", "中文、。한글", "ascii", "", None, "ао", "½ ™ →", "Յովհաննես ու ո", "ᎠᎰᏊ ᎰᎢ"):
        assert kinds(text) == [], text
    assert PLAIN.rewrite("\U0001f469‍\U0001f527")[0] == "\U0001f469‍\U0001f527"  # without the joiner it would look different
    assert PLAIN.rewrite("한") == ("한", [])


def test_idempotent_and_equal():
    for a, b in (("Ｃａｆé", "Café"), ("a b", "a b"), ("ﬀ", "ff")):
        assert PLAIN.rewrite(a)[0] == PLAIN.rewrite(b)[0]
    for t in ("ріесеѕ оf Ｆｏｌｄｅｒ café​", "нoвый", "한 x́"):
        once = PLAIN.rewrite(t)[0]
        assert PLAIN.rewrite(once)[0] == once


def test_classes_are_transitive_and_chosen_by_frequency():
    u = lo.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        u.union(a, b)
    assert sorted(u.classes()) == [["a", "b", "c", "d"], ["x", "y"]]
    row = next(c for c in lo.find_classes() if "Y" in c)
    assert {"Υ", "У", "Ү"} <= set(row)
    assert lo.choose([row], {"Ү": 9, "У": 3}).letters["Cyrillic"]["Y"] == "Ү" and lo.choose([row], {"Ү": 3, "У": 9}).letters["Cyrillic"]["Y"] == "У"


def test_fields(spark):
    from folioscan.llm import encoding

    model = encoding.fit(["Der Kran prüft das Büro für Öl.", "café – “note” fermé à 5 €"] * 30)
    rows = spark.createDataFrame([(1, "a b", "Ａ", "k"), (2, None, "", "k"), (3, "dÃ©jÃ  fermÃ© cafÃ©", None, "k"), (1, "a b", None, "k")], "match_id bigint, context string, document_text string, kinds string")
    got = sorted((r.match_id, r.field, r.unified) for r in lo.unify_fields(rows, lo.fit_on(rows), model).collect())
    assert got == [(1, "context", "a b"), (1, "context", "a b"), (1, "document_text", "A")]
    assert 3 in {r.match_id for r in lo.unify_fields(rows, lo.fit_on(rows)).collect()}
    empty = rows.limit(0)
    assert lo.unify_fields(empty, lo.fit_on(empty), model).count() == 0
    assert lo.code_point_counts(rows, ("context",))[" "] == 3
