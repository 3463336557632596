"""Users given out and erased over all tables."""

import json

import pytest

from tidemark.operators import accounts
from tidemark.operators.accounts import Held
from tidemark.sources import store

HELD = {"turns": Held("user_id"), "sessions": Held("owner", ("sid", "note")), "empty": Held("user_id")}


@pytest.fixture
def tables(spark):
    return {
        "turns": spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "nobody")], "user_id long, text string"),
        "sessions": spark.createDataFrame([(10, 1, None), (11, 3, "x")], "sid long, owner long, note string"),
        "empty": spark.createDataFrame([], "user_id long, v long"),
    }


def test_all_rows_of_a_user_are_given_out(spark, tables):
    users = spark.createDataFrame([(1,), (1,), (9,), (None,)], "user_id long")
    got = sorted((r.user_id, r.table, json.dumps(json.loads(r.row), sort_keys=True)) for r in accounts.export(tables, HELD, users).collect())
    assert got == [(1, "sessions", '{"note": null, "sid": 10}'), (1, "turns", '{"text": "a", "user_id": 1}'), (1, "turns", '{"text": "a", "user_id": 1}')]


def test_erased_users_are_gone_from_all_versions(spark, tables, tmp_path):
    root = str(tmp_path)
    for name, df in tables.items():
        store.commit(df, f"{root}/{name}")
    store.commit(tables["turns"].where("user_id = 1"), f"{root}/turns")
    store.commit(tables["turns"], f"{root}/turns")
    users = spark.createDataFrame([(1,), (9,)], "user_id long")
    done = {r.table: (r.deleted, r.left) for r in accounts.erase(spark, root, HELD, users).collect()}
    assert done == {"turns": (2, 2), "sessions": (1, 1), "empty": (0, 0)}
    assert sorted((r.user_id or 0) for r in store.read_current(spark, f"{root}/turns").collect()) == [0, 2]
    assert [store.current_version(spark, f"{root}/{n}") for n in HELD] == [3, 1, 0]
    for name in HELD:  # one version and its data are all that is there
        assert len(store.names(spark, f"{root}/{name}/versions")) == 1
        assert len([n for n in store.names(spark, f"{root}/{name}") if n.startswith("data-")]) == 1
    again = {r.table: r.deleted for r in accounts.erase(spark, root, HELD, users).collect()}
    assert again == {"turns": 0, "sessions": 0, "empty": 0} and store.current_version(spark, f"{root}/turns") == 3


def test_a_run_that_fails_while_it_writes_erases_nothing(spark, tables, tmp_path):
    root = str(tmp_path)
    for name in ("turns", "sessions"):  # the last table is not there
        store.commit(tables[name], f"{root}/{name}")
    with pytest.raises(Exception):
        accounts.erase(spark, root, HELD, spark.createDataFrame([(1,)], "user_id long"))
    assert store.read_current(spark, f"{root}/turns").count() == 4 and store.current_version(spark, f"{root}/turns") == 0
