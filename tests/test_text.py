import math
import random
from collections import Counter

from pyspark.sql import functions as F

from larkspur.functions import text as T


def test_entropy_equals_counting(spark, monkeypatch):
    """Few and many distinct characters, beyond the basic plane too, within an array's elements as well."""
    r = random.Random(1)
    draw = lambda low, high, n: "".join(chr(r.randrange(low, high)) for _ in range(n))
    texts = ["", "a", "aab", "日本" * 500 + "\n", "é" * 3 + "😀😀x", draw(32, 500, 3000), draw(0x4E00, 0x5E00, 5000), draw(0x1F300, 0x1F600, 2000), "\0\0a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: (x["e"], x["l"][0]) for x in rows.select("i", T.entropy(F.col("t")).alias("e"), F.transform(F.array("t"), T.entropy).alias("l")).collect()}
    for i, t in enumerate(texts):
        want = -sum(k / len(t) * math.log2(k / len(t)) for k in Counter(t).values()) if t else 0.0
        assert abs(got[i][0] - want) < 1e-9 and abs(got[i][1] - want) < 1e-9
