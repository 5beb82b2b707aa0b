import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from ledgerloom.functions import text


COMPACTED = {
    "": "", " \t ": "", "a": "a", "a  b": "a b", "a\t \tb": "a b", " a \n b ": "a\nb", "a\r\nb\rc\n\n\nd": "a\nb\nc\nd",
    "\r\n\r\n": "", "a\xa0\xa0b": "a b", "　a　b　": "a b", "\x1ca\x85": "a", "a\x0bb": "a\x0bb", "\x0c\na": "a",
    "é": "\xe9", "ﬁn": "fin", "２": "2", "\xdfΣ": "\xdfΣ", "a \x0b\nb": "a\nb",
}


def test_compacted_texts(spark):
    rows = spark.createDataFrame(list(COMPACTED.items()), "s string, t string").select(
        "s", "t", text.compact(F.col("s")).alias("compact")
    )
    assert [(r.s, r.compact) for r in rows.collect() if r.compact != r.t] == []


def random_texts(count):
    rnd = random.Random(7)
    alphabet = "ab \t\n\r\x0b\x0c\x1c\x85\xa0　   éﬁßΣς1２é"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(count)]


def test_random_texts_match_python(spark):
    rows = (
        spark.createDataFrame([(t,) for t in random_texts(5000)], "s string")
        .select(
            "s",
            text.strip(F.col("s")).alias("strip"),
            text.fold(F.col("s")).alias("fold"),
        )
        .collect()
    )
    assert [r.s for r in rows if r.strip != r.s.strip()] == []
    assert [r.s for r in rows if r.fold != re.sub(r"\s+", "", r.s).casefold()] == []


def test_whitespace_is_pythons():
    assert sorted(text.WHITESPACE) == [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]


def test_stable_characters_need_no_normalisation():
    stable = re.compile("[" + text.NFKC_STABLE + "]")
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if stable.match(char):
            assert unicodedata.normalize("NFKC", char) == char
            assert unicodedata.combining(char) == 0


def test_casefold_of_assigned_characters(spark):
    # Letters newer than Python's Unicode data are folded by Java only.
    chars = [
        chr(p)
        for p in range(1, sys.maxunicode + 1)
        if not 0xD800 <= p < 0xE000 and unicodedata.category(chr(p)) != "Cn"
    ]
    rows = spark.createDataFrame([(c,) for c in chars], "s string").select(
        "s", text.casefold(F.col("s")).alias("f")
    )
    assert [r.s for r in rows.collect() if r.f != r.s.casefold()] == []


def test_token_estimate(spark):
    rows = spark.range(0, 12).select(
        "id", text.token_estimate(F.col("id").cast("int")).alias("n")
    ).collect()
    assert {r.id: r.n for r in rows} == {i: max(1, (i + 3) // 4) for i in range(12)}
