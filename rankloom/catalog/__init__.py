"""Registered queries, each with the SQL that must give the same rows."""

from rankloom.catalog import (  # noqa: F401  (importing registers the queries)
    a_sources,
    b_sampling,
    c_rows,
    d_windows,
    e_joins,
    f_reference,
    g_priors,
    h_factors,
    i_models,
    j_fusion,
    k_metrics,
    l_profile,
    m_jobs,
)
from rankloom.catalog.base import REGISTRY

__all__ = ["REGISTRY"]
