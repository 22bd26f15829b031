import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "er", "ing"]) for _ in range(n))


def documents(seed=3, n=60):
    """Rows of documents: ordinary texts, copies, near copies, junk, and the odd cases."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(20, 120)) + ".", "en", f"s{i % 3}", 0) for i in range(n)]
    base = rows[0][1]
    rows += [(n + i, base, "en", "s0", 0) for i in range(4)]
    rows += [(n + 10 + i, base.replace(base.split()[5], "changed", 1), "en", "s1", 0) for i in range(2)]
    rows += [(n + 20, None, "en", "s1", 0), (n + 21, "", "en", "s1", 0), (n + 22, " \n\t", None, None, None), (n + 23, "a", "en", "s2", 1), (n + 24, "é" * 70, "fr", "s2", 70)]
    rows += [(n + 30, " ".join(["WIN!!", "###", "$$$"] * 60), "en", "s2", 0), (n + 31, sentence(rng, 4000), "en", "s2", 0), (n + 31, rows[1][1], "en", "s2", 0), (None, rows[2][1], "en", "s0", 0)]
    rows += [(n + 40, base + " 12 " + rows[3][1], "en", "s0", 0), (n + 41, "x\n" + "same line here\n" * 9, "en", "s0", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """A folder of tables: the documents of rows, with labels, benchmark and pages."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(90, 0, 0), (None, 1, 0), (3, 1, 0), (3, 0, 0), (9999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    cut = lambda i, a, b: " ".join(rows[i][1].split()[a:b])
    items = [(1, cut(5, 2, 16)), (2, cut(6, 0, 10).upper()), (2, cut(6, 0, 10)), (3, "never seen words stand here at all in any of these"), (4, "changed"), (5, None), (6, "..."), (None, cut(7, 3, 15))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """A folder of empty tables."""
    path = str(tmp_path_factory.mktemp("nothing"))
    for name, schema in {"documents": SCHEMA, "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path
