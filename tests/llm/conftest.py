import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators use inside or return.
CLASHES = ["_key", "_rid", "_row", "_text", "_node", "h", "s", "part", "size", "target", "kept", "n_words", "item", "shard", "times", "_w", "_h", "_id"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edge_docs():
    """Nulls, empty and very long texts, ties, repeated rows and ids, odd white space, near copies."""
    rng = random.Random(3)
    base = words(rng, 200)
    rows = [
        (1, None, "en", "b"), (2, "", "en", None), (3, "   \n\t ", None, "a"), (4, "one two three", "en", "a"), (5, "One TWO three", "en", "b"),
        (6, "one two three four", "en", "b"), (7, "Été ÉTÉ été İstanbul Σίσυφος straße   x y", "fr", "ä"),
        (8, " ".join(base), "en", "a"), (9, " ".join(base).upper(), "en", "a"), (10, "\n".join(base), "en", "b"),
        (11, " ".join(base[:190] + words(rng, 10)), "en", "b"), (12, " ".join(base[:120] + words(rng, 80)), "en", None),
        (13, " ".join(words(rng, 30_000, 5000)), "en", "a"), (14, "spam " * 60, "en", "a"), (15, "# $ % & | < > * " * 20, "en", "b"),
        (16, "the and of to. " * 9 + "\n" + "the and of to. " * 9, "en", "b"), (17, "a\x00b\x01c \x7f d", "en", "a"),
        (18, "😀 👩‍👩‍👧 text with emoji " * 12, "en", "c"), (19, "x" * 3000, "en", "c"), (None, "a text without an id " * 6, "en", "c"),
        (20, " ".join(base), "de", "c"), (20, " ".join(base), "de", "c"), (21, "  lead and trail  ", "en", "a"), (22, "two  spaces\n\nlines <|endoftext|> end ", "en", "a"),
    ]
    return [(i, t, lang, src, len(t) if t is not None else None) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The edge cases with extra columns, read from files as the operators' inputs are."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("edge") / "docs")
    df = spark.createDataFrame(edge_docs(), DOC_SCHEMA)
    df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def frame(spark, tmp_path, rows, schema=DOC_SCHEMA, parts=3):
    path = str(tmp_path / "frame")
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def same_rows(got, want):
    """Rows as multisets, columns by name."""
    columns = sorted(got.columns)
    key = lambda r: tuple((r[c] is None, str(r[c])) for c in columns)
    a = sorted((key(r.asDict()) for r in got.collect()))
    b = sorted((key(r) for r in want))
    assert a == b, [x for x in a if x not in b][:3] + [x for x in b if x not in a][:3]


def duck(sql, **tables):
    """Rows of DuckDB SQL over the given Spark frames."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return [dict(zip(names, r)) for r in rel.fetchall()]
