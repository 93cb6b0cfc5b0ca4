"""Compatibility folding and Arabic tokens against Python's own tables."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from siftwell.functions import arabic as A

MARKS = re.compile("[ؐ-ًؚ-ٰٟۖ-ۭ]")


def plain_folded(text):
    out = unicodedata.normalize("NFKC", text).translate(str.maketrans(A.LETTERS, A.FOLDED)).replace(A.TATWEEL, "")
    return re.sub(r"\s+", " ", MARKS.sub("", out)).strip()


def plain_tokens(text):
    out = []
    for t in re.findall("[؀-ۿݐ-ݿࢠ-ࣿ]+", plain_folded(text)):
        out += [x for x in ([t, t[1:]] if t[0] == "و" and len(t) > 2 else [t]) if x not in out]
    return out


def test_plain_letters_are_their_own_form():
    letters = [chr(c) for c in range(0x110000) if re.fullmatch(A.PLAIN.replace(r"\x{", r"\u").replace("}", ""), chr(c))]
    assert len(letters) > 300
    rng = random.Random(3)
    texts = letters + ["".join(rng.choices(letters, k=40)) for _ in range(2000)] + [a + b for a in letters[::3] for b in letters[::3]]
    assert all(unicodedata.normalize("NFKC", t) == t for t in texts)


def test_folding_against_plain_rules(spark):
    rng = random.Random(5)
    pool = "ﺍﺎﻻﷲﷺﺑﻛﻣوَالْكِتَابـُ أإآٱى abcÉé①ﬁＡ  　\x1f\n٣ ۝ۖ一ｶﾞ한éآ"
    texts = ["", " ", "plain text", "وال وا و ووو", "ﷲ ﻻﻻ"] + ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string").repartition(3)
    rows = {r["id"]: r for r in df.select("id", A.compatible(F.col("t")).alias("c"), A.folded_arabic(F.col("t")).alias("f"), A.folded_tokens(F.col("t")).alias("k"), A.query_variants(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        f = plain_folded(t)
        assert rows[i]["c"] == unicodedata.normalize("NFKC", t) and rows[i]["f"] == f and rows[i]["k"] == plain_tokens(t)
        assert rows[i]["v"] == ([f] if f else []) + ([f[1:]] if f.startswith("و") and len(f) > 2 else [])
    assert rows[len(texts)]["c"] is None and rows[len(texts)]["f"] is None
