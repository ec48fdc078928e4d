import pytest

SMALL = "/root/testdata/sf0.001"
#: Null, empty, blank, odd and repeated texts; rows repeated whole; ids null and repeated; a very long text without breaks.
TEXTS = [
    (1, "Alpha beta gamma delta.\nAll rights reserved. CC BY\n", "en", "a.example.com"),
    (2, None, None, None),
    (3, "", "en", ""),
    (4, " \t\n\r ", "xx", "a.example.com"),
    (5, "ÉCOLE ﬁne ① Ωmega K mailto:x.y@z.example.com, +1 (555) 010-9999 and 1.2.3.4", "fr", "b.example.com"),
    (5, "another text of the same id", "fr", "b.example.com"),
    (None, "a text without an id\nmore", "de", "c.example.org"),
    (None, "a text without an id\nmore", "de", "c.example.org"),
    (6, "Alpha beta gamma delta.\nAll rights reserved. CC BY\n", "en", "a.example.com"),
    (7, "x" * 300_000, "es", "d"),
    (8, "one two", "es", "d"),
    (9, "a  b   c ▁▁d \x00 end ", "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case, and columns of clashing names."""
    rows = [(*r, i, "t", [i]) for i, r in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long, dropped string, `odd.name` array<int>").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """Small tables in many jobs: three partitions a shuffle are enough."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
