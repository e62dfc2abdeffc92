"""Uniform L3 detector.

``AnomalyDetector(algorithm, window=8, threshold_percentile=2.0,
max_train_samples=None, params={})``:

* unsupervised (isolation_forest, one_class_svm, lof): fit on label = 0
  rows (one_class_svm by its exact dual, or ``solver="features"`` for the approximation), threshold = exact ``threshold_percentile``-th percentile of the
  training scores; alert when score < threshold (low = anomalous);
* supervised (random_forest -> histogram forest, xgboost ->
  histogram boosting): fit on all labelled rows with class weights,
  threshold = max-F1 threshold on the training scores; alert when
  score >= threshold; score = P(label = 1).

Features are the 20 window columns; when the input already carries them
they are reused (computed once, J2/J3), otherwise they are computed.
"""

from __future__ import annotations

import json
import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from aerolens.operators import curves
from aerolens.operators.combine import ml_decision
from aerolens.operators.features import compute_features
from aerolens.operators.frames import HOT_ROWS
from aerolens.operators.models import boosting, forest, iforest, lof, ocsvm, ocsvm_dual
from aerolens.operators.models.sampling import class_weights, subsample
from aerolens.schema import (DEFAULT_FEATURE_WINDOW, DEFAULT_FLIGHT_KEYS, DEFAULT_MAX_TRAIN_SAMPLES,
                             FEATURE_NAMES, SUPERVISED, SUPPORTED_ALGOS, UNSUPERVISED)


class AnomalyDetector:
    def __init__(self, algorithm: str, window: int = DEFAULT_FEATURE_WINDOW,
                 threshold_percentile: float = 2.0, max_train_samples: int | None = None,
                 params: dict | None = None, flight_keys=DEFAULT_FLIGHT_KEYS,
                 fill: str = "backfill", hot_rows: int | None = HOT_ROWS):
        if algorithm not in SUPPORTED_ALGOS:
            raise ValueError(f"Unknown algorithm: {algorithm}. Available: {SUPPORTED_ALGOS}")
        self.algorithm = algorithm
        self.window = int(window)
        self.threshold_percentile = float(threshold_percentile)
        self.max_train_samples = (DEFAULT_MAX_TRAIN_SAMPLES.get(algorithm)
                                  if max_train_samples is None else max_train_samples)
        self.params = dict(params or {})
        self.flight_keys = tuple(flight_keys)
        self.fill = fill
        self.hot_rows = hot_rows
        self.model = None
        self.threshold: float | None = None
        self.optimal_threshold: float | None = None
        self.feature_names: list[str] = []

    # ------------------------------------------------------------ helpers
    @property
    def supervised(self) -> bool:
        return self.algorithm in SUPERVISED

    def _p(self, key, default):
        return self.params.get(key, default)

    def with_features(self, df: DataFrame) -> DataFrame:
        if all(c in df.columns for c in FEATURE_NAMES):
            return df
        return compute_features(df, self.window, self.flight_keys, self.fill, hot_rows=self.hot_rows)

    # --------------------------------------------------------------- fit
    def fit(self, train: DataFrame) -> "AnomalyDetector":
        """Fit on ``train``.  A fit on a capped sample persists that sample
        only; the others read all training features several times (training
        passes, threshold) and persist them for the duration of the fit."""
        if self.algorithm in ("lof", "one_class_svm") and not self.max_train_samples:
            raise ValueError(f"{self.algorithm} needs a cap: max_train_samples must be positive")
        spark = train.sparkSession
        self.feature_names = list(FEATURE_NAMES)
        seed = int(self._p("random_state", 42))
        df = self.with_features(train).select("label", *self.feature_names, *[
            c for c in ("replicate", "case_id", "row_idx", "_ord") if c in train.columns])
        if self.max_train_samples:
            rows = df.filter(F.col("label") == 0) if self.algorithm in UNSUPERVISED else df.filter(F.col("label").isNotNull())
            df = subsample(rows, self.max_train_samples, seed)
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if self.algorithm in UNSUPERVISED:
                clean = df.filter(F.col("label") == 0)
                self._fit_unsupervised(spark, clean, seed)
                # the threshold reads the scores twice (cut points, sums): score once
                scored = clean.select(self._score_expr(spark).alias("ml_score")).persist()
                self.threshold = float(curves.percentile_threshold(
                    scored, "ml_score", self.threshold_percentile).first()["threshold"])
                scored.unpersist()
            else:
                lab = df.filter(F.col("label").isNotNull())
                self._fit_supervised(lab, seed)
                scored = self._raw_scores(lab).select("label", "ml_score").persist()
                best = curves.max_f1_threshold(scored, "ml_score", direction="high").first()
                self.optimal_threshold = float(best["threshold"]) if best else 0.5
                scored.unpersist()
        finally:
            df.unpersist()
        return self

    def _fit_unsupervised(self, spark: SparkSession, clean: DataFrame, seed: int):
        cols = self.feature_names
        if self.algorithm == "isolation_forest":
            forest, psi = iforest.fit_forest(clean, cols, int(self._p("n_estimators", 150)),
                                             int(self._p("max_samples", 256)), seed)
            self.model = ("isolation_forest", iforest.forest_arrays(forest), psi)
        elif self.algorithm == "lof":
            R, kd, lrd, k = lof.fit_lof(spark, clean, cols, int(self._p("n_neighbors", 20)))
            self.model = ("lof", R, kd, lrd, k)
        elif self._p("solver", "dual") == "dual":
            self.model = ("one_class_svm_dual", *ocsvm_dual.fit_dual(spark, clean, cols, float(self._p("nu", 0.05)),
                                                                    self._p("gamma", "scale")))
        else:                                            # solver "features": the approximation
            W, b, w, rho = ocsvm.fit_ocsvm(spark, clean, cols, float(self._p("nu", 0.05)),
                                           self._p("gamma", "scale"),
                                           int(self._p("n_components", 256)),
                                           int(self._p("iters", 80)), seed=seed)
            self.model = ("one_class_svm", W, b, w, rho)

    def _fit_supervised(self, lab: DataFrame, seed: int):
        if self.algorithm == "xgboost":
            w = class_weights(lab, "label", "pos_ratio")
            self.model = ("xgboost", boosting.fit_boosting(lab, self.feature_names, boosting.Settings(
                rounds=int(self._p("n_estimators", 300)), depth=int(self._p("max_depth", 8)),
                rate=float(self._p("learning_rate", 0.05)), subsample=float(self._p("subsample", 0.9)),
                colsample=float(self._p("colsample_bytree", 0.9)), positive_weight=float(self._p("scale_pos_weight", w[1])),
                l2=float(self._p("reg_lambda", 1.0)), min_hessian=float(self._p("min_child_weight", 1.0)),
                bins=int(self._p("max_bin", boosting.BINS)), seed=seed)))
            return
        w = class_weights(lab, "label", self._p("class_weight", "balanced") or "none")
        self.model = ("random_forest", forest.fit_trees(lab, self.feature_names, forest.Settings(
            trees=int(self._p("n_estimators", 200)), depth=int(self._p("max_depth", 16)), min_leaf=int(self._p("min_samples_leaf", 20)),
            weights=(float(w[0]), float(w[1])), max_features=self._p("max_features", "sqrt"), bins=int(self._p("max_bin", forest.BINS)), seed=seed)))

    # ------------------------------------------------------------ scoring
    def _score_expr(self, spark: SparkSession):
        kind = self.model[0]
        cols = self.feature_names
        if kind == "isolation_forest":
            return iforest.score_column(spark, self.model[1], self.model[2], cols)
        if kind == "lof":
            return lof.score_column(spark, *self.model[1:], cols)
        if kind == "random_forest":
            return forest.score_column(spark, self.model[1], cols)
        if kind == "xgboost":
            return boosting.score_column(spark, self.model[1], cols)
        if kind == "one_class_svm_dual":
            return ocsvm_dual.score_column(spark, *self.model[1:], cols)
        return ocsvm.score_column(spark, *self.model[1:], cols)

    def _raw_scores(self, df: DataFrame) -> DataFrame:
        return df.withColumn("ml_score", self._score_expr(df.sparkSession))

    def predict(self, df: DataFrame, ml_threshold: float | None = None) -> DataFrame:
        """Adds ``ml_score`` and ``alert_ml`` (F12 override with ``ml_threshold``)."""
        if self.model is None:
            raise RuntimeError("Call fit() before predict()")
        df = self.with_features(df)
        present = [c for c in df.columns if c in self.feature_names]
        if present != self.feature_names:
            warnings.warn("Feature order differs from the model's; using the model's order.")
        out = self._raw_scores(df)
        if ml_threshold is not None:
            t = ml_threshold
        elif self.supervised:
            t = self.optimal_threshold if self.optimal_threshold is not None else 0.5
        else:
            t = self.threshold
        return out.withColumn("alert_ml", ml_decision(F.col("ml_score"), self.supervised, t))

    # ------------------------------------------------------- persistence
    def _meta(self) -> dict:
        return {"algorithm": self.algorithm, "window": self.window,
                "threshold_percentile": self.threshold_percentile,
                "max_train_samples": self.max_train_samples, "params": self.params,
                "flight_keys": list(self.flight_keys), "fill": self.fill,
                "threshold": self.threshold, "optimal_threshold": self.optimal_threshold,
                "feature_names": self.feature_names}

    def save(self, spark: SparkSession, path: str) -> None:
        """Metadata row (JSON) + model (Parquet tables)."""
        meta = spark.createDataFrame([(json.dumps(self._meta()),)], "meta string")
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
        kind = self.model[0]
        if kind == "isolation_forest":
            rows = [(i, t[0].tolist(), t[1].tolist(), t[2].tolist(), t[3].tolist(),
                     [int(x) for x in t[4]]) for i, t in enumerate(self.model[1])]
            spark.createDataFrame(rows, iforest.TREE_SCHEMA).write.mode("overwrite") \
                .parquet(f"{path}/trees")
            extra = {"psi": self.model[2]}
        elif kind == "random_forest":
            spark.createDataFrame(forest.tree_rows(self.model[1]), forest.TREE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
            extra = {}
        elif kind == "xgboost":
            rows = [(i, *(c.tolist() for c in t)) for i, t in enumerate(self.model[1])]
            spark.createDataFrame(rows, boosting.TREE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
            extra = {}
        elif kind == "lof":
            _, R, kd, lrd, k = self.model
            rows = [(i, R[i].tolist(), float(kd[i]), float(lrd[i])) for i in range(R.shape[0])]
            spark.createDataFrame(rows, "id long, x array<double>, kdist double, lrd double") \
                .write.mode("overwrite").parquet(f"{path}/reference")
            extra = {"k": k}
        elif kind == "one_class_svm_dual":
            _, S, a, c, rho, gamma = self.model
            rows = [(S[i].tolist(), int(c[i]), float(a[i])) for i in range(len(S))]
            spark.createDataFrame(rows, ocsvm_dual.SV_SCHEMA).write.mode("overwrite").parquet(f"{path}/vectors")
            extra = {"rho": rho, "gamma": gamma}
        else:
            _, W, b, w, rho = self.model
            rows = [(j, W[:, j].tolist(), float(b[j]), float(w[j])) for j in range(W.shape[1])]
            spark.createDataFrame(rows, "j long, wcol array<double>, b double, w double") \
                .write.mode("overwrite").parquet(f"{path}/rff")
            extra = {"rho": rho}
        spark.createDataFrame([(json.dumps(extra),)], "extra string").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/extra")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "AnomalyDetector":
        import numpy as np
        meta = json.loads(spark.read.json(f"{path}/metadata").first()["meta"])
        det = AnomalyDetector(meta["algorithm"], meta["window"], meta["threshold_percentile"],
                              meta["max_train_samples"], meta["params"], tuple(meta["flight_keys"]),
                              meta["fill"])
        det.threshold, det.optimal_threshold = meta["threshold"], meta["optimal_threshold"]
        det.feature_names = meta["feature_names"]
        extra = json.loads(spark.read.json(f"{path}/extra").first()["extra"])
        if det.algorithm == "isolation_forest":
            det.model = ("isolation_forest",
                         iforest.forest_arrays(spark.read.parquet(f"{path}/trees")), extra["psi"])
        elif det.algorithm == "random_forest":
            det.model = ("random_forest", forest.trees_of(spark.read.parquet(f"{path}/trees").orderBy("tree_id").collect()))
        elif det.algorithm == "xgboost":
            trees = spark.read.parquet(f"{path}/trees").orderBy("tree_id").collect()
            det.model = ("xgboost", [tuple(np.array(r[c]) for c in ("feature", "threshold", "left", "right", "value")) for r in trees])
        elif det.algorithm == "lof":
            rows = spark.read.parquet(f"{path}/reference").orderBy("id").collect()
            det.model = ("lof", np.array([r["x"] for r in rows]), np.array([r["kdist"] for r in rows]),
                         np.array([r["lrd"] for r in rows]), extra["k"])
        elif "gamma" in extra:
            rows = spark.read.parquet(f"{path}/vectors").collect()
            det.model = ("one_class_svm_dual", np.array([r["x"] for r in rows]), np.array([r["a"] for r in rows]),
                         np.array([r["c"] for r in rows]), extra["rho"], extra["gamma"])
        else:
            rows = spark.read.parquet(f"{path}/rff").orderBy("j").collect()
            W = np.array([r["wcol"] for r in rows]).T
            det.model = ("one_class_svm", W, np.array([r["b"] for r in rows]),
                         np.array([r["w"] for r in rows]), extra["rho"])
        return det


def detect_ml_anomalies(test: DataFrame, train: DataFrame, algorithm: str = "isolation_forest",
                        **kwargs) -> DataFrame:
    """M9: fit on ``train`` and predict ``test``."""
    return AnomalyDetector(algorithm, **kwargs).fit(train).predict(test)


def compare_algorithms(train: DataFrame, test: DataFrame, algorithms=SUPPORTED_ALGOS,
                       params: dict | None = None) -> DataFrame:
    """precision/recall/F1 (+ fit time) per algorithm on one feature table.

    Features are computed once for train and test and reused (J3); a failing
    algorithm has its message in ``error`` and no figures.  The loop is over algorithms (a handful), every
    fit/score inside is a distributed job.
    """
    import time

    from aerolens.operators.evaluation import confusion

    spark = train.sparkSession
    probe = AnomalyDetector(algorithms[0])
    tr = probe.with_features(train).persist()
    te = probe.with_features(test).persist()
    rows = []
    for algo in algorithms:
        t0 = time.time()
        try:
            det = AnomalyDetector(algo, params=(params or {}).get(algo))
            out = det.fit(tr).predict(te)
            m = confusion(out, "alert_ml").first().asDict()
        except Exception as e:  # noqa: BLE001 - the others are still compared
            warnings.warn(f"{algo} failed: {e}")
            rows.append((algo, *[None] * 7, round(time.time() - t0, 1), f"{type(e).__name__}: {str(e)[:300]}"))
            continue
        rows.append((algo, m["TP"], m["FP"], m["TN"], m["FN"], float(m["precision"]),
                     float(m["recall"]), float(m["f1"]), round(time.time() - t0, 1), None))
    tr.unpersist()
    te.unpersist()
    return spark.createDataFrame(rows, "algorithm string, TP long, FP long, TN long, FN long, "
                                       "precision double, recall double, f1 double, time_s double, error string")
