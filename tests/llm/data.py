"""Small documents with the cases that operators must survive."""

import random

WORDS = "the of and to in that was with ener tion stra ber ouwhea ñandú élan größe x1 don't".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ","]) for _ in range(n))


def documents(seed=1, n=60):
    """(doc_id, text, lang, source): copies, near copies, shared passages and lines, odd texts."""
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 160))) for _ in range(n)]
    passage = " ".join(f"p{i}" for i in range(60))
    line = "This very line is found in many of the documents"
    out = []
    for i, t in enumerate(base):
        kind = i % 6
        if kind == 1:
            t = base[i - 1]
        elif kind == 2:
            w = base[i - 2].split()
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        elif kind == 3:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        elif kind == 4:
            t = t + "\n" + line + "\n" + t[:30] + "\n  " + line.upper() + " \n"
        out.append((i, t, "en", f"src{i % 3}"))
    odd = [None, "", "   ", "\n\n", "one", "one two", "a a a a a a a a a a a a a a a a a a", "ünï ñ 中文 😀 Σ", "x" * 70, "z " * 5000, passage, line + "\n" + line]
    out += [(n + i, t, None if i % 2 else "fr", None if i == 3 else "odd") for i, t in enumerate(odd)]
    out += [out[0], out[0], (None, "a text whose identifier is missing " * 4, "en", "src0"), (None, None, None, None)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, path, extra=True):
    """A stored table, with columns whose names operators may use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("id", "n", "page", "h", "row", "component", "kept", "t", "host"):
            df = df.withColumn(c, F.lit("clash"))
    df.repartition(3).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def unique(rows):
    """Rows with distinct, non-null ids."""
    seen, out = set(), []
    for r in rows:
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    return out
