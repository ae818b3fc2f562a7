"""Bounded samples on tables of any size."""

from landloom.llm.common import bounded_sample, share_of


class Counted:
    """A DataFrame that says it has so many rows."""

    def __init__(self, df, n):
        self.df, self.n = df, n

    def count(self):
        return self.n

    def __getattr__(self, name):
        return getattr(self.df, name)


def test_share_does_not_vanish(spark):
    assert share_of(12_000, 10**11) > 10**11 and share_of(1, 2**62) == 2
    df = spark.range(100_000).selectExpr("id as doc_id", "id % 7 as v")
    got = bounded_sample(Counted(df, 10**9), "doc_id", 500_000, 3).count()  # a share of 1 in 2,000
    assert 25 <= got <= 90
    assert bounded_sample(df, "doc_id", 20_000, 3).count() in range(19_000, 21_000)
    assert bounded_sample(df.union(df), "doc_id", 20_000, 3).count() in range(9_000, 11_000)  # equal rows count once


def test_a_key_of_many_rows(spark):
    df = spark.range(60_000).selectExpr("1 as doc_id", "cast(id as string) as text")
    assert bounded_sample(df, "doc_id", 12_000, 5).count() in range(11_500, 12_500)
