import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alder birch cedar dogwood elm fir ginkgo hazel ivy juniper katsura larch maple nutmeg oak pine quince rowan spruce teak umbra viburnum willow xylem yew zelkova".split()


def prose(seed: int, n: int, per_line: int = 12) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]).capitalize() + "." for i in range(0, n, per_line))


def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, one very long text."""
    rows = [(k, prose(k, 40 + 7 * k), ("en", "de")[k % 2], f"s{k % 3}", None) for k in range(1, 13)]
    rows += [(20, None, "en", "s1", 0), (21, "", "de", None, 0), (22, " \n\t", None, "s1", None), (None, prose(3, 61), "en", "s0", 5), (None, None, None, None, None)]
    rows += [rows[0], rows[0], (30, rows[1][1], "en", "s2", 1), (31, rows[2][1] + " extra", "de", "s2", 1)]
    rows.append((40, prose(99, 20000), "en", "s0", 1))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for name in ("rid", "rid2", "key", "words", "n", "bands", "removed", "kept", "piece", "Row", "hit", "emptied"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """A data folder with the odd rows as documents and a small benchmark."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    first = odd_rows()[4][1].replace("\n", " ").split()
    items = [("a", " ".join(first[5:20])), ("b", " ".join(first[30:34]).upper()), ("c", None), ("d", "..."), ("a", " ".join(first[40:52])), (None, " ".join(first[0:10])), ("e", "no such words at all in any of the texts here")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d
