"""Token uncertainty against a numpy restatement of the reference arithmetic (property-based)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as hs

from poolpick.operators import uncertainty as unc


def reference_token_scores(z, lab):
    """log-softmax per position, masked positions zeroed, sorted descending; margins of the
    two largest; min skips zero margins (inf if none), mean/mnlp divide by unmasked count."""
    ls = z - (z.max(axis=1, keepdims=True) + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(1, keepdims=True)))
    mask = (lab != -100)[:, None]
    ls = ls * mask
    srt = -np.sort(-ls, axis=1)
    margin = srt[:, 0] - srt[:, 1]
    live = mask[:, 0].sum()
    nz = margin[margin != 0]
    return {"min": float(nz.min()) if len(nz) else math.inf,
            "mean": float(margin.sum() / live) if live else None,
            "max": float(margin.max()),
            "mnlp": float(srt[:, 0].sum() / live) if live else None}


row = hs.lists(hs.tuples(hs.lists(hs.sampled_from([-1.5, -0.25, 0.0, 0.5, 2.0, 3.25]), min_size=3, max_size=3),
                         hs.sampled_from([0, 1, 2, -100])), min_size=1, max_size=6)


@settings(max_examples=12, deadline=None)
@given(hs.lists(row, min_size=1, max_size=4))
def test_token_uncertainty_matches_reference_arithmetic(spark, rows):
    data = [(rid, pos, [float(x) for x in z], lab) for rid, r in enumerate(rows) for pos, (z, lab) in enumerate(r)]
    df = spark.createDataFrame(data, "row_id long, pos int, z array<double>, lab int")
    for method in unc.TOKEN_METHODS:
        got = {r.row_id: r.uncertainty for r in unc.token_uncertainty(df, method).collect()}
        for rid, r in enumerate(rows):
            z = np.array([p[0] for p in r], dtype=float)
            lab = np.array([p[1] for p in r])
            want = reference_token_scores(z, lab)[method]
            if want is None:
                assert got[rid] is None
            elif math.isinf(want):
                assert math.isinf(got[rid])
            else:
                assert abs(got[rid] - want) < 1e-9, (method, rid, got[rid], want)
