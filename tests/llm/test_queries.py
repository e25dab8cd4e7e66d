"""The queries on the smallest tables: against their SQL, and whole where SQL can't tell."""

import os

import duckdb
import pytest

from tagloom.llm.queries import QUERIES
from tagloom.llm.sql import SQL


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, db, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = db.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert got == sorted((tuple(row[order.index(c)] for c in columns) for row in result.fetchall()), key=repr)


def test_found_queries_have_the_given_columns(spark, small):
    want = {"p1": "act entity_type is_negative", "p2": "record_id", "p3": "pub_no", "p4": "record_id field", "p5": "act_id_a act_id_b",
            "p6": "act_id_a act_id_b", "p7": "doc_id item_id", "p8": "source", "p9": "doc_id"}
    for p, columns in want.items():
        df = QUERIES[f"{p}_found"](spark, small)
        assert df.columns == columns.split()
        assert df.count() == df.distinct().count()


def test_split_leaves_no_publication_in_two_splits(spark, small, db):
    made = QUERIES["p3_split"](spark, small).toPandas()
    db.register("made", made)
    assert db.execute("SELECT count(DISTINCT act_id) FROM gner_records").fetchone()[0] == len(made) == made.act_id.nunique()
    bad = db.execute("""SELECT regexp_replace(publication, '[^0-9]', '', 'g')::BIGINT AS p FROM gner_records JOIN made USING (act_id)
        WHERE publication IS NOT NULL GROUP BY 1 HAVING count(DISTINCT made.split) > 1""").fetchall()
    assert bad == []


def test_groups_are_the_components_of_the_pairs(spark, small):
    group = {r.act_id: r.group_id for r in QUERIES["p6_groups"](spark, small).collect()}
    for r in QUERIES["p6_found"](spark, small).collect():
        assert group[r.act_id_a] == group[r.act_id_b]


def test_pieces_fit_and_cover(spark, small):
    limit = {"input": 1100, "output": 1900}
    for r in QUERIES["p4_pieces"](spark, small).collect():
        assert len(r.piece) == r.stop - r.start <= limit[r.field]


@pytest.mark.parametrize("name", ["p2_report", "p3_report", "p8_report", "p9_report", "p9_agreement"])
def test_reports(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
