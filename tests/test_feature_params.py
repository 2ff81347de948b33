"""Saved and loaded feature parameters give the same features."""

import numpy as np

from relevo.operators import features as ft
from relevo.plans import featurize as fz
from tests.conftest import SF_SMALL


def test_saved_parameters_give_the_same_features(spark, tmp_path):
    pairs, prods = fz.notebook_inputs(spark, SF_SMALL)
    fp = fz.fit_feature_params(pairs, prods, latent=3)
    fz.save_feature_params(spark, fp, str(tmp_path / "params"))
    again = fz.load_feature_params(spark, str(tmp_path / "params"))
    assert np.array_equal(fp.basis.v, again.basis.v) and np.array_equal(fp.basis.s, again.basis.s)
    assert {f: (p.n_docs, p.avgdl) for f, p in fp.bm25_params.items()} == {f: (p.n_docs, p.avgdl) for f, p in again.bm25_params.items()}
    few = pairs.orderBy("pair_id").limit(20)
    rows = [{r.pair_id: [r[c] for c in ft.FEATURE_ORDER] for r in fz.compute_features(few, prods, p).collect()} for p in (fp, again)]
    assert rows[0].keys() == rows[1].keys() and all(np.allclose(rows[0][k], rows[1][k]) for k in rows[0])
