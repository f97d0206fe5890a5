"""Scaling and model helpers on top of pyspark.ml."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _RobustParams(HasInputCols, HasOutputCols):
    lower = Param(Params._dummy(), "lower", "lower quantile", TypeConverters.toFloat)
    upper = Param(Params._dummy(), "upper", "upper quantile", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(lower=0.25, upper=0.75)


class RobustScalerExact(Estimator, _RobustParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - median) / (q_upper - q_lower) with exact linear-interpolated
    quantiles; a zero range divides by 1 (F7).

    ``pyspark.ml.feature.RobustScaler`` uses approximate quantiles that pick
    a sample element and maps zero-range columns to 0, so it is not the same
    transform.  The fit is one aggregation over all columns.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, lower=0.25, upper=0.75):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RobustScalerExactModel":
        from vigil.operators.quantiles import exact_quantiles
        cols = self.getInputCols()
        lo, hi = self.getOrDefault("lower"), self.getOrDefault("upper")
        q = {(r.column, r.p): r.value for r in exact_quantiles(df, cols, [lo, 0.5, hi]).collect()}
        med = [float(q[(c, 0.5)]) for c in cols]
        rng = [float(q[(c, hi)] - q[(c, lo)]) for c in cols]
        m = RobustScalerExactModel(inputCols=cols, outputCols=self.getOutputCols(), medians=med,
                                   ranges=[v if v != 0 else 1.0 for v in rng])
        return self._copyValues(m)


class RobustScalerExactModel(Model, _RobustParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    ranges = Param(Params._dummy(), "ranges", "fitted quantile ranges", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, medians=None, ranges=None, lower=0.25, upper=0.75):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        ins, outs = self.getInputCols(), self.getOutputCols()
        med, rng = self.getOrDefault("medians"), self.getOrDefault("ranges")
        return df.select("*", *[((F.col(c).cast("double") - m) / r).alias(o)
                                for c, o, m, r in zip(ins, outs, med, rng)])
