import random

import pytest

from evkit.operators.ranks import ranked, running_sums
from tests.conftest import rows_of, table


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    # One group holds most rows, one is null.
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i) for i in range(2000)]
    return data, table(spark, "g string, v int, id int", data).repartition(6)


def test_places_in_groups(rows):
    data, df = rows
    want = []
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        want += [(*r, i) for i, r in enumerate(own)]
    assert rows_of(ranked(df, ["g"], ["-v", "id"])) == sorted(want, key=lambda r: [(x is not None, str(type(x)) if x is None else x) for x in r])


def test_places_without_groups_and_of_nothing(rows):
    data, df = rows
    got = {r.id: r["rank"] for r in ranked(df, [], ["id"]).collect()}
    assert got == {i: i for i in range(2000)}
    assert ranked(df.limit(0), ["g"], ["id"]).count() == 0


def test_running_sums(rows):
    data, df = rows
    got = {r.id: r.before for r in running_sums(df, ["g"], ["id"], {"v": "before"}).collect()}
    seen = {}
    for g, v, i in data:
        assert got[i] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
