"""Kernel support vector machine (D7): a Nystroem map of the kernel and a linear hinge machine on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.sql import DataFrame

from binlens.operators.reduce import NystroemModel, fit_nystroem

KERNELS = ("linear", "poly", "rbf", "sigmoid")


@dataclass
class KernelSvmModel:
    """``transform`` adds ``rawPrediction`` and ``prediction``, row by row; ``embedding`` is None for the linear kernel."""

    embedding: NystroemModel | None
    machine: LinearSVCModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.machine.transform(self.embedding.transform(df) if self.embedding else df)


def fit_kernel_svm(train: DataFrame, kernel: str = "rbf", C: float = 1.0, gamma: float = 0.2, degree: float = 3, coef0: float = 0.0,
                   n_components: int = 250, max_iter: int = 100, id_col: str = "id", features_col: str = "features",
                   label_col: str = "label") -> KernelSvmModel:
    """Penalty ``C`` on the summed hinge loss (0 < C: regularisation 1 / (C n) on the mean). The linear kernel needs no map:
    its machine sees the features themselves. The map is exact where the rows span at most ``n_components`` landmarks."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r} is none of {', '.join(KERNELS)}")
    if C <= 0:
        raise ValueError("C must be positive")
    n = train.count()
    if n == 0:
        raise ValueError("no training rows")
    embedding = None
    if kernel != "linear":
        embedding = fit_nystroem(train, id_col, features_col, "kernel_features", n_components, kernel, gamma, degree, coef0)
    column = "kernel_features" if embedding else features_col
    machine = LinearSVC(featuresCol=column, labelCol=label_col, regParam=1.0 / (C * n), maxIter=max_iter, standardization=False)
    return KernelSvmModel(embedding, machine.fit(embedding.transform(train) if embedding else train))
