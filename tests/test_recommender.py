"""The apartment recommender's builds and requests run in many tasks."""

from plotwise.operators import quantiles
from plotwise.operators import similarity as R
from plotwise.plans import recommender

SCHEMA = "PropertyName string, TopFacilities string, PriceDetails string, LocationAdvantages string"


def apartment(i):
    return (f"apt {i}", f"['Hall {i % 3}', 'Pool']", f"{{'{i % 3 + 1} BHK': {{'building_type': '{'Villa' if i % 2 else 'Floor'}', "
            f"'area': '1,{100 + i} sq.ft. - 2,200 sq.ft.', 'price-range': '₹ {10 + i} L - 1.5 Cr'}}}}",
            f"{{'Metro {i % 2}': '{i + 1} Km', 'Mall': 'near'}}")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_price_details_are_parsed_after_their_names_are_dealt_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(recommender, "computed_once", lambda df: seen.append(plan(df)) or quantiles.computed_once(df))
    rows = spark.createDataFrame([apartment(i) for i in range(6)] + [apartment(0)] * 3, SCHEMA)
    found = recommender.price_long(rows).collect()
    assert len({r.id for r in found}) == 6 and len(found) == len({(r.id, r.feature) for r in found})
    # top first: names are dealt out below the choice of one text for each, and the parser reads what was chosen
    dealt = seen[0].index("RepartitionByExpression")
    assert 0 < seen[0].index("Aggregate") < dealt and 0 < seen[0].rindex("from_json") < dealt


def test_entries_are_not_shuffled_by_their_few_keys(spark):
    long = spark.createDataFrame([(i, k, float(i + len(k))) for i in range(20) for k in ("a", "bb")], "id long, k string, v double")
    stats, deltas = R.standardise_long(long, long.select("id").distinct(), "id", "k", "v", 0.0)
    assert "strategy=broadcast" in plan(deltas)
    assert {r.k: round(r.std, 6) for r in stats.collect()} == {"a": 5.766281, "bb": 5.766281}
    assert deltas.count() == 40


def test_a_request_ranks_the_best_rows_of_each_task_only(spark, tmp_path):
    rows = spark.createDataFrame([apartment(i) for i in range(30)] + [(None, "['x']", None, None)], SCHEMA)
    recommender.build(rows, str(tmp_path / "index"))
    out = recommender.recommend(spark, str(tmp_path / "index"), ["apt 3"], 4)
    assert "WindowGroupLimit" in plan(out)
    scores = {r.id: r.score for r in recommender.scores(spark, str(tmp_path / "index"), ["apt 3"]).collect()}
    best = sorted(scores, key=lambda i: (-round(scores[i], 10), i))[1:5]
    assert [(r["rank"], r.id) for r in sorted(out.collect(), key=lambda r: r["rank"])] == list(enumerate(best, 1))
    assert len(scores) == 30
