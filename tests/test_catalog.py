"""Every catalog query runs on the smallest tables; those with SQL give DuckDB's rows."""

import pytest
from oracle import connect, difference

from penstock.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert difference(spark, con, QUERIES[name], SQL[name], SF) is None
    else:
        QUERIES[name](spark, SF).count()


def test_reconcile_lines_takes_all_facts(spark):
    from penstock.plans.catalog import items
    from penstock.plans.catalog_entities import reconcile_lines

    got, want = {}, {}
    for r in reconcile_lines(spark, SF).collect():
        got.setdefault(r.fact_id, []).append(round(r.total_price, 2))
        assert r.reconciled  # the printed total is the lines' own sum
    for r in items(spark, SF).select("fact_id", "total_price").collect():
        want.setdefault(r.fact_id, []).append(round(float(r.total_price), 2))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_product_resolve_knows_every_vendor(spark):
    from penstock.plans.catalog import items
    from penstock.plans.catalog_entities import product_resolve

    names = items(spark, SF).selectExpr("crc32(cast(name as binary)) as q").distinct()
    assert {r.q for r in product_resolve(spark, SF).collect()} == {r.q for r in names.collect()}


def test_identity_lookup_asks_for_all_facts(spark):
    from penstock.plans.catalog import facts
    from penstock.plans.catalog_entities import identity_lookup

    assert sorted(r.q for r in identity_lookup(spark, SF).collect()) == sorted(r.id for r in facts(spark, SF).select("id").collect())


def test_entity_embeddings_take_whole_documents(spark):
    from penstock.plans.catalog_entities import entity_embeddings

    want = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "size(split(lower(concat_ws(' ', source, text)), '\\\\s+')) as n").collect()
    got = entity_embeddings(spark, SF).where("kind = 'document'").collect()
    assert sorted((r.entity, sum(r.embedding)) for r in got) == sorted((f"document:{r.doc_id}", r.n) for r in want)
