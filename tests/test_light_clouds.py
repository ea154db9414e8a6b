"""What clouds shuffle: light rows for blocks, no row repeated for its aggregates."""

from penstock.operators import resolution
from penstock.plans import catalog_entities as entities

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]


def test_bundles_know_their_slugs_without_a_join(spark):
    text = plan(entities._noisy_bundles(spark, SF))
    assert text.count("SortMergeJoin") + text.count("BroadcastHashJoin") <= 4  # customers and nations, of two kinds of bundles


def test_pairs_are_cut_off_from_their_blocks(spark):
    text = plan(resolution.score_pairs(resolution.candidate_pairs(entities._noisy_bundles(spark, SF))))
    assert "RDDScan" in text or "Scan ExistingRDD" in text  # pairs were written, so their blocks' shuffles may go
    assert "xxhash64" not in text


def test_collapsing_repeats_no_row(spark):
    b = entities._noisy_bundles(spark, SF)
    text = plan(resolution.collapse_clouds(b, b.selectExpr("ord", "ord as cloud")))
    assert "Expand" not in text


def test_the_state_of_an_aggregate_is_not_shuffled(spark):
    b = entities._noisy_bundles(spark, SF)
    text = plan(resolution.collapse_clouds(b, b.selectExpr("ord", "ord as cloud")))
    at = text.index("REPARTITION_BY_COL")
    assert "min_by" in text[:at] and "min_by" not in text[at:]


def test_finished_steps_are_let_go(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(resolution, "let_go", lambda s: gone.append(s))
    b = entities._noisy_bundles(spark, SF).where("ord < 200")
    resolution.form_clouds(b).count()
    assert len(gone) == 2
