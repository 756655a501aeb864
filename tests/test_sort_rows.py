"""The sort emulator assembles its rows once for the fits and scores of all folds."""

from rankloom.models import rankers


def test_rows_are_assembled_once(log, monkeypatch):
    calls, inner = [], rankers.assemble
    monkeypatch.setattr(rankers, "assemble", lambda *args, **kw: calls.append(1) or inner(*args, **kw))
    narrow = log.select("srch_id", "prop_id", "position", "random_bool", "price_usd", "prop_starrating")
    done, _ = rankers.sort_emulator(narrow, None, n_folds=2, rounds=1)
    assert len(calls) == 1 and done.where("sort_emulator_score IS NULL").isEmpty() and done.count() == log.count()
