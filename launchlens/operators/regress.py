"""Linear models: least squares, lasso by L1 share, backward elimination by AIC.

All three are solved from cross products, which one pass over the rows gathers
for every fold at once. A fit, its standard errors included, then costs p x p
arithmetic on the driver, and k-fold resampling costs one more pass to score,
whatever k and however many grid points. Rows with a NULL take no part in a fit
and get a NULL prediction.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from launchlens.operators.evaluate import regression_metrics
from launchlens.operators.gram import LassoPath, Swept, student_p
from launchlens.operators.moments import CrossProducts, cross_products

__all__ = [
    "Inference",
    "LinearFit",
    "fit_lasso",
    "fit_linear",
    "fit_step_aic",
    "fold_summary",
    "lasso_path",
    "linear_summary",
]


@dataclass
class Inference:
    """What least squares says about its coefficients: NULL for a column that is a combination of earlier ones.

    The terms are the columns in order, then ``(Intercept)``.
    """

    n: int
    df: int
    r2: float | None
    sigma: float | None
    estimates: dict[str, float | None]
    errors: dict[str, float | None]

    def rows(self) -> list[tuple[str, float | None, float | None, float | None, float | None]]:
        """(term, estimate, std_error, t, p) of every term."""
        out = []
        for term, b in self.estimates.items():
            error = self.errors[term]
            t = p = None
            if error:
                t = b / error
                p = student_p(t, self.df)
            out.append((term, b, error, t, p))
        return out

    @property
    def t_values(self) -> dict[str, float | None]:
        return {term: t for term, _, _, t, _ in self.rows()}


@dataclass
class LinearFit:
    """Coefficients in original units, with what resampling said about them."""

    intercept: float
    coefs: dict[str, float]
    tuning: dict[str, float] = field(default_factory=dict)
    resampled: DataFrame | None = None
    summary: Inference | None = None
    by_fold: dict[int, Inference] = field(default_factory=dict)

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for name, b in self.coefs.items():
            if b:
                out = out + F.lit(b) * F.col(name)
        return out

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.score())


def _in_units(products: CrossProducts, b: np.ndarray, b0: float, xs: Sequence[str]) -> LinearFit:
    """Back from centred, scaled columns; the target is the last column."""
    p = len(xs)
    slopes = b * products.scale[-1] / products.scale[:p]
    intercept = products.mean[-1] + b0 * products.scale[-1] - float(slopes @ products.mean[:p])
    return LinearFit(float(intercept), dict(zip(xs, map(float, slopes))))


def _split(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Sums around the means of these rows: n, S_xx, S_xy, mean x, mean y, S_yy."""
    n = gram[0, 0]
    means = gram[0, 1:] / n
    s = gram[1:, 1:] - n * np.outer(means, means)
    return n, s[:-1, :-1], s[:-1, -1], means[:-1], means[-1], s[-1, -1]


def _swept(gram: np.ndarray) -> Swept:
    _, sxx, sxy, _, _, syy = _split(gram)
    return Swept(sxx, sxy, syy)


def _intercept(gram: np.ndarray, b: np.ndarray) -> float:
    *_, mx, my, _ = _split(gram)
    return float(my - b @ mx)


def _inference(products: CrossProducts, gram: np.ndarray, swept: Swept, xs: Sequence[str]) -> Inference:
    n, _, _, mx, my, syy = _split(gram)
    used, p = swept.cols, len(xs)
    df = int(round(n)) - len(used) - 1
    unit, target = products.scale[:p], products.scale[-1]
    estimates: dict[str, float | None] = dict.fromkeys([*xs, "(Intercept)"])
    errors: dict[str, float | None] = dict(estimates)
    slopes = swept.slopes
    spread = swept.rest / df if df > 0 else None
    inverse = swept.inverse
    for at, j in enumerate(used):
        estimates[xs[j]] = float(slopes[j] * target / unit[j])
        if spread is not None:
            errors[xs[j]] = float(math.sqrt(spread * inverse[at, at]) * target / unit[j])
    fit = _in_units(products, slopes, float(my - slopes @ mx), xs)
    estimates["(Intercept)"] = fit.intercept
    if spread is not None:
        # The point where all columns are 0, as seen from these rows' means.
        away = (mx + products.mean[:p] / unit)[used]
        errors["(Intercept)"] = float(math.sqrt(spread * (1 / n + away @ inverse @ away)) * target)
    return Inference(
        int(round(n)), df, float(1 - swept.rest / syy) if syy > 0 else None,
        math.sqrt(spread) * float(target) if spread is not None else None, estimates, errors)


def _by_fold(
    df: DataFrame, y: str, fold: str, fits: dict[int, LinearFit], back: Callable[[Column], Column] | None
) -> DataFrame:
    """Metrics of each fold under the fit that did not see it: one pass for all folds."""
    score: Column = F.lit(None).cast("double")
    for f, fit in fits.items():
        score = F.when(F.col(fold) == f, fit.score()).otherwise(score)
    units = back or (lambda c: c)
    held = df.select(fold, units(F.col(y)).alias("obs"), units(score).alias("pred"))
    return regression_metrics(held, by=[fold])


def fit_linear(
    df: DataFrame, y: str, xs: Sequence[str], fold: str | None = None
) -> LinearFit:
    """Least squares with standard errors, t and p values, all from the cross products.

    With a fold column, also the coefficients of the fit without each fold
    (``by_fold``) and the metrics of each held-out fold, NULL for a fold that holds all
    rows. A column that is a combination of those before it gets slope 0 and no statistics.
    """
    products = cross_products(df, [*xs, y], fold)

    def solve(gram: np.ndarray) -> LinearFit:
        swept = _swept(gram)
        fit = _in_units(products, swept.slopes, _intercept(gram, swept.slopes), xs)
        fit.summary = _inference(products, gram, swept, xs)
        return fit

    out = solve(products.gram())
    if fold:
        fits = {f: solve(products.gram(f)) for f in sorted(products.folds) if len(products.folds) > 1}
        out.by_fold = {f: fit.summary for f, fit in fits.items()}
        out.resampled = _by_fold(df, y, fold, fits, None)
    return out


_SUMMARY = "term string, estimate double, std_error double, t double, p double"


def linear_summary(df: DataFrame, fit: LinearFit) -> DataFrame:
    """Coefficient table of a least-squares fit: (term, estimate, std_error, t, p)."""
    return df.sparkSession.createDataFrame(fit.summary.rows(), _SUMMARY)


def fold_summary(df: DataFrame, fit: LinearFit) -> DataFrame:
    """The same for the fits without each fold, with the number of rows they saw: (fold, n, term, ...)."""
    rows = [(f, part.n, *row) for f, part in fit.by_fold.items() for row in part.rows()]
    return df.sparkSession.createDataFrame(rows, f"fold int, n long, {_SUMMARY}")


# --- lasso -----------------------------------------------------------------------

def _lasso_path(gram: np.ndarray) -> tuple[LassoPath, np.ndarray]:
    """The path on standardised columns, and the columns' lengths (0 for a constant one)."""
    _, sxx, sxy, *_ = _split(gram)
    lengths = np.sqrt(np.maximum(np.diag(sxx), 0.0))
    lengths[lengths <= 1e-9] = 0.0
    unit = np.where(lengths > 0, lengths, 1.0)
    scaled = sxx / np.outer(unit, unit)
    scaled[lengths == 0, :] = 0.0
    scaled[:, lengths == 0] = 0.0
    return LassoPath.trace(scaled, np.where(lengths > 0, sxy / unit, 0.0)), lengths


def _lasso_shares(gram: np.ndarray, shares: Sequence[float]) -> dict[float, np.ndarray]:
    """Slopes whose L1 norm is each share of the least-squares one, from one path."""
    path, lengths = _lasso_path(gram)
    unit = np.where(lengths > 0, lengths, 1.0)
    return {s: path.at_share(s) / unit for s in shares}


def lasso_path(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """The knots of the lasso path: (step, term, share, estimate), estimates in original units.

    ``share`` is the L1 norm of the standardised slopes over that at the end. Between
    two knots every estimate is linear in the share.
    """
    products = cross_products(df, [*xs, y])
    gram = products.gram()
    path, lengths = _lasso_path(gram)
    unit = np.where(lengths > 0, lengths, 1.0)
    norms = path.norms
    rows = []
    for step, slopes in enumerate(path.slopes):
        fit = _in_units(products, slopes / unit, _intercept(gram, slopes / unit), xs)
        share = float(norms[step] / norms[-1]) if norms[-1] else 1.0
        rows += [(step, term, share, b) for term, b in [*fit.coefs.items(), ("(Intercept)", fit.intercept)]]
    return df.sparkSession.createDataFrame(rows, "step int, term string, share double, estimate double")


def fit_lasso(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    fold: str | None = None,
    fractions: Sequence[float] = (1.0, 0.1, 0.01, 0.001),
) -> LinearFit:
    """Lasso at the L1 share with the lowest resampled RMSE (the first share without folds).

    A share is met exactly on the path, which is followed once for all shares.
    One pass scores every share of every fold.
    """
    products = cross_products(df, [*xs, y], fold)

    def solve(gram: np.ndarray, shares: Sequence[float]) -> dict[float, LinearFit]:
        return {s: _in_units(products, b, _intercept(gram, b), xs)
                for s, b in _lasso_shares(gram, shares).items()}

    scores: dict[float, float] = {}
    best, resampled = fractions[0], None
    if fold:
        fits = {f: solve(products.gram(f), fractions) for f in products.folds}
        held = _shares_by_fold(df, y, fold, fits, fractions).collect()
        for share in fractions:
            parts = [r["rmse"] for r in held if r["share"] == share and r["rmse"] is not None]
            scores[share] = sum(parts) / len(parts) if parts else math.inf
        best = min(fractions, key=lambda s: scores[s])
        resampled = df.sparkSession.createDataFrame(
            [(r["fold"], r["rmse"], r["r2"], r["mae"]) for r in held if r["share"] == best],
            f"`{fold}` int, rmse double, r2 double, mae double")
    out = solve(products.gram(), [best])[best]
    out.tuning = {"fraction": float(best), **{f"rmse_{s:g}": v for s, v in scores.items()}}
    out.resampled = resampled
    return out


def _shares_by_fold(
    df: DataFrame, y: str, fold: str, fits: dict[int, dict[float, LinearFit]], shares: Sequence[float]
) -> DataFrame:
    """Metrics by share and held-out fold: (share, fold, rmse, r2, mae)."""
    def score(share: float) -> Column:
        out: Column = F.lit(None).cast("double")
        for f, fit in fits.items():
            out = F.when(F.col(fold) == f, fit[share].score()).otherwise(out)
        return out

    each = F.array(*[F.struct(F.lit(float(s)).alias("share"), score(s).alias("pred")) for s in shares])
    held = (df.filter(F.col(fold).isNotNull())
            .select(F.col(fold).cast("int").alias("fold"), F.col(y).alias("obs"), F.explode(each).alias("s"))
            .select("fold", "obs", "s.share", "s.pred"))
    return regression_metrics(held, by=["share", "fold"])


# --- backward elimination ------------------------------------------------------------

def _backward(gram: np.ndarray) -> tuple[Swept, float]:
    """The columns left after dropping, one at a time, whichever lowers the AIC most.

    All columns are swept in, and each trial reads off what its column holds of
    the rest of squares. Ties go to the first column; columns that are
    combinations of earlier ones were never in.
    """
    n = gram[0, 0]
    swept = _swept(gram)

    def aic(rest: float, columns: int) -> float:
        return n * math.log(max(rest, 1e-300) / n) + 2 * (columns + 1)

    current = aic(swept.rest, len(swept.cols))
    while swept.cols:
        trials = [(aic(rest, len(swept.cols) - 1), col)
                  for rest, col in zip(swept.rest_without(), swept.cols, strict=True)]
        lowest, drop = min(trials)
        if lowest >= current:
            break
        swept.drop(drop)
        current = lowest
    return swept, current


def fit_step_aic(
    df: DataFrame, y: str, xs: Sequence[str], fold: str | None = None
) -> LinearFit:
    """Least squares on the columns that backward elimination by AIC keeps."""
    products = cross_products(df, [*xs, y], fold)

    def solve(gram: np.ndarray) -> tuple[LinearFit, float]:
        swept, value = _backward(gram)
        return _in_units(products, swept.slopes, _intercept(gram, swept.slopes), xs), value

    out, value = solve(products.gram())
    # AIC of the target in its own units.
    n = products.gram()[0, 0]
    out.tuning = {"aic": float(value + 2 * n * math.log(products.scale[-1]))}
    out.coefs = {x: b for x, b in out.coefs.items() if b}
    if fold:
        fits = {f: solve(products.gram(f))[0] for f in products.folds}
        out.resampled = _by_fold(df, y, fold, fits, None)
    return out
