"""The listwise model writes its feature table once and drops negatives from it without a shuffle."""

from rankloom.models import rankers


def test_negatives_are_dropped_in_place(log, monkeypatch):
    seen, inner = [], rankers.fit_ranker
    monkeypatch.setattr(rankers, "fit_ranker", lambda rows, *args, **options: seen.append(rows) or inner(rows, *args, **options))
    model = rankers.fit_xendcg(log, None, ["price_usd", "prop_starrating"], rounds=1, depth=2)
    rows = seen[0].rows
    assert len(model.trees) == 1 and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert 0 < rows.count() < log.count()
