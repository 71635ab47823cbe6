"""Many binomial fits in one loop, against single fits and a plain Newton iteration."""

import math

import numpy as np
import pytest

from posigauge.operators import glm, glm_batch


def plain_fit(data, link):
    """Newton on x, k, n with halving, in numpy."""
    x, k, n = (np.array(c, float) for c in zip(*data))
    y = k / n
    share = k.sum() / n.sum()
    here = np.array([math.log(share) if link == "log" else math.log(share / (1 - share)), 0.0])

    def at(b):
        mu = np.exp(b[0] + b[1] * x) if link == "log" else 1 / (1 + np.exp(-(b[0] + b[1] * x)))
        if np.any(mu >= 1):
            return None
        hit = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0)
        miss = np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1) / (1 - mu)), 0)
        g = n * (y - mu) / (1 - mu) if link == "log" else n * (y - mu)
        c = n * mu * (1 - y) / (1 - mu) ** 2 if link == "log" else n * mu * (1 - mu)
        h = n * mu / (1 - mu) if link == "log" else c
        moments = lambda v: np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]])
        return 2 * (n * (hit + miss)).sum(), np.array([g.sum(), (g * x).sum()]), moments(c), moments(h)

    now = at(here)
    for _ in range(60):
        step = np.linalg.solve(now[2], now[1])
        while (new := at(here + step)) is None or new[0] > now[0] + 1e-9:
            step = step / 2
        here, now = here + step, new
    return here, now[0], np.linalg.inv(now[3])


def groups():
    rng = np.random.default_rng(4)
    out = {}
    for name, (a, b) in {"calm": (-2, 1.5), "steep": (-3, 9), None: (-1, -2), "near one": (-0.9, 0.85)}.items():
        x = rng.uniform(0, 1, 40)
        n = rng.integers(5, 60, 40)
        mean = np.exp(np.minimum(a + b * x, -0.02)) if name == "near one" else 1 / (1 + np.exp(-(a + b * x)))
        out[name] = [(float(u), int(rng.binomial(m, p)), int(m)) for u, m, p in zip(x, n, mean)]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = [(name, *r) for name, some in groups().items() for r in some]
    data += [("no hits", 0.1 * i, 0, 9) for i in range(5)] + [("flat", 0.5, i, 9) for i in range(5)]
    data += [("split", 0.1 * i, 0 if i < 5 else 7, 7) for i in range(10)]  # success from 0.5 on: no finite fit
    frame = spark.createDataFrame(data, "g string, x double, k long, n long").repartition(5)
    return glm.model_rows(frame, "x", "k", "n", by=["g"])


@pytest.mark.parametrize("link", ["logit", "log"])
def test_groups_equal_plain_fits(rows, link):
    got = {r["g"]: r for r in glm_batch.fit_many(rows, ["g"], link, max_rounds=14).collect()}
    assert set(got) == {*groups(), "no hits", "flat", "split"}
    for name in ("no hits", "flat"):
        assert not got[name]["settled"] and got[name]["intercept"] is None and got[name]["observations"] == 5
    for name in groups() if link == "logit" else ["calm", None, "near one"]:
        r = got[name]
        coefficients, deviance, cov = plain_fit(groups()[name], link)
        assert r["settled"] and r["observations"] == 40
        assert (r["intercept"], r["slope"]) == pytest.approx(tuple(coefficients), rel=1e-7, abs=1e-8)
        assert r["deviance"] == pytest.approx(deviance, rel=1e-9)
        assert (r["v00"], r["v01"], r["v11"]) == pytest.approx((cov[0, 0], cov[0, 1], cov[1, 1]), rel=1e-6)
    if link == "logit":
        assert not got["split"]["settled"]


def test_single_fit_agrees(rows):
    calm = rows.where("g = 'calm'")
    one = glm.fit_binomial(calm, "x")
    many = glm_batch.fit_many(calm).first()
    assert (one.intercept, one.slope, one.v11) == pytest.approx((many["intercept"], many["slope"], many["v11"]), rel=1e-8)
    assert (one.null_deviance, one.pearson_chi2) == pytest.approx((many["null_deviance"], many["pearson_chi2"]), rel=1e-8)


def test_open_and_empty(rows):
    few = glm_batch.fit_many(rows.where("g = 'steep'"), ["g"], max_rounds=2).first()
    assert not few["settled"] and few["slope"] is None
    assert glm_batch.fit_many(rows.where("false"), ["g"]).count() == 0
    with pytest.raises(ValueError):
        glm_batch.fit_many(rows, ["g"], "probit")


def test_pooled_rows(rows):
    both = glm_batch.pooled(rows.where("g in ('calm', 'steep')"), "g")
    found = {r["g"]: r["count"] for r in both.groupBy("g").count().collect()}
    assert found == {"calm": 40, "steep": 40, "pooled": 80}
