"""Registered jobs run with the rounds of a default run."""

from types import SimpleNamespace

from rankloom.catalog import i_models, m_jobs
from rankloom.models import rankers
from rankloom.plans import runs


def test_model_jobs_run_with_the_default_settings(monkeypatch):
    seen = []
    monkeypatch.setattr(runs, "validation_run", lambda log, s: seen.append(s) or ("predictions", "fit"))
    monkeypatch.setattr(runs, "split_stability", lambda log, settings: seen.append(settings))
    m_jobs.validation(SimpleNamespace(log=None))
    m_jobs.stability(SimpleNamespace(log=None))
    assert seen == [runs.Settings()] * 2


def test_seed_average_has_the_rounds_of_a_run(monkeypatch):
    seen = {}

    def average(train, held, features, target, seeds, **options):
        seen.update(options, seeds=seeds)
        return None, []

    monkeypatch.setattr(i_models, "_frame", lambda ctx: None)
    monkeypatch.setattr(i_models.sampling, "train_validation_split", lambda df: (None, None))
    monkeypatch.setattr(i_models, "_report", lambda *a: None)
    monkeypatch.setattr(rankers, "xendcg_average", average)
    i_models.xendcg(None)
    s = runs.Settings()
    assert seen == {"seeds": s.seeds, "patience": s.patience, **s.boosting()} and seen["rounds"] == 100
