"""Experiments: instance selection by hashing and by genetic search, benchmarks, feature reduction, result trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import bayes, genetic as G, learners, lsh, measures as M, relational as R, relevancy as V, sampling as S
from faultline.session import cut


def with_features(df: DataFrame, vector: str, n: int) -> tuple[DataFrame, list[str]]:
    """The first ``n`` entries of an array column as feature columns."""
    names = [f"x{k}" for k in range(n)]
    return df.select("*", *[F.col(vector)[k].alias(f"x{k}") for k in range(n)]), names


def _measured(scored: DataFrame, label: str) -> DataFrame:
    final = cut(scored.select(F.col(label).cast("double").alias("actual"), "score"))
    return M.with_measures(M.confusion(final)).crossJoin(M.auc(final).select("auc"))


def lsh_selection(train: DataFrame, test: DataFrame, features: list[str], vector: str, label: str, stages: int = 2, buckets: int = 8, seed: int = 7, learner: str = "Naive Bayes", validation: list[DataFrame] | None = None) -> DataFrame:
    """Measures on ``test`` of ``learner`` trained on the best hash bucket of ``train``, with the bucket and its fitness.

    Rows are hashed by Super-Bit on features and label, stage 0 names the bucket; the bucket whose model
    does best on the ``validation`` sets (by default the whole training set) is kept. Buckets with one class compete as well.
    """
    dim = len(train.select(vector).first()[0]) + 1
    n, blocks = lsh.superbit_shape(stages, buckets, dim)
    planes = lsh.superbit_planes(dim, n, blocks, seed)
    sig = lsh.superbit_signature(F.concat(F.col(vector), F.array(F.col(label).cast("double"))), planes)
    hashed = cut(train.withColumn("chrm", lsh.stage_hashes_bool(sig, n * blocks, stages, buckets)[0]).withColumn("label", F.col(label).cast("double")))
    fitness = G.assign_fitness(hashed, validation or [train], features, label, learner)
    best = min(fitness, key=lambda c: (-fitness[c], c))
    scored = learners.fit_score(learner, hashed.where(F.col("chrm") == best), test, features, "label")
    return _measured(scored, label).select("*", F.lit(best).alias("bucket"), F.lit(fitness[best]).alias("fitness"))


def lsh_tuned(train: DataFrame, test: DataFrame, features: list[str], vector: str, label: str, options: int = 3, min_buckets: int = 6, max_buckets: int = 6, min_stages: int = 2, max_stages: int = 2, seed: int = 7, learner: str = "Naive Bayes") -> DataFrame:
    """The best of ``options`` seeded draws of (stages, buckets), each from [min, min + max - 1], by fitness."""
    rng = np.random.default_rng(seed)
    best, kept = -1.0, None
    for k in range(options):
        st, bu = int(rng.integers(min_stages, min_stages + max_stages)), int(rng.integers(min_buckets, min_buckets + max_buckets))
        out = cut(lsh_selection(train, test, features, vector, label, st, bu, seed + k, learner).withColumn("stages", F.lit(st)).withColumn("buckets", F.lit(bu)))
        fitness = out.first()["fitness"]
        if fitness > best:  # a tie keeps the earlier draw
            best, kept = fitness, out
    return kept


def genetic_selection(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", key: str = "id", by_distribution: bool = False, validation: list[DataFrame] | None = None, **settings) -> DataFrame:
    """Measures on ``test`` of the learner trained on the best subset found by ``genetic.Search`` (its ``settings``), with the fitness.

    With ``by_distribution`` fitness is the similarity of each chromosome's feature distributions to the test set.
    """
    search = G.Search(features, label, key, **settings)
    if by_distribution:
        search.extra = lambda pop: similarities(pop, test, features)
    search.fit(train, validation)
    return _measured(search.predict(test), label).withColumn("fitness", F.lit(float(search.fitness)))


def similarities(pop: DataFrame, test: DataFrame, features: list[str]) -> dict[int, float]:
    """Score of the Kolmogorov-Smirnov p-values between each chromosome and the test set, all in one pass."""
    return {r["chrm"]: float(r["score"] or 0.0) for r in V.ks_score(V.ks_similarity(pop, test, features, by="chrm"), "chrm").collect()}


def distribution_selection(train: DataFrame, test: DataFrame, features: list[str], label: str = "label", key: str = "id", parts: int = 1, **settings) -> DataFrame:
    """``genetic_selection`` by distribution for each of ``parts`` parts of the test set, measured on the pooled predictions."""
    scored = G.by_parts(train, test, lambda: G.Search(features, label, key, **settings), parts, lambda pop, part: similarities(pop, part, features))
    return _measured(scored, label)


def nn_filter_benchmark(train: DataFrame, test: DataFrame, features: list[str], vector: str, label: str, ks: list[int], key: str = "vec_id", learner: str = "Naive Bayes", metrics: list[str] = ["euclidean"], tune_cut: bool = True) -> DataFrame:
    """(k, cf, fit, measures): ``learner`` on the training rows among the k nearest of a test row under any of ``metrics``; k and cut-off picked on the training set."""
    best = None
    for k in ks:
        kept = cut(train.join(V.nn_filter(train, test, k, metrics, key), key, "left_semi"))
        own = learners.fit_score(learner, kept, train, features, label).select(F.col(label).cast("double").alias("actual"), "score")
        sweep = M.best_threshold(M.threshold_sweep(own)).first()
        if sweep is not None and (best is None or sweep["fit"] > best[1]["fit"]):
            best = (k, sweep, kept)
    k, sweep, kept = best
    cf = sweep["cf"] if tune_cut else 0.5
    out = learners.fit_score(learner, kept, test, features, label).select((F.col(label) >= 1).cast("double").alias("actual"), (F.col("score") >= cf).cast("double").alias("score"))
    return M.with_measures(M.confusion(out)).select(F.lit(k).alias("k"), F.lit(cf).alias("cf"), F.lit(sweep["fit"]).alias("fit"), "*")


def cross_validation(df: DataFrame, features: list[str], label: str, key: str, folds: int = 5, by: list[str] | None = None, seed: int = 11, learner: str = "Naive Bayes") -> DataFrame:
    """Measures of ``learner`` under stratified folds, per ``by``, pooled over folds. Naive Bayes models are fitted in one aggregation, others fold by fold."""
    by = by or []
    dealt = cut(S.stratified_folds(df, label, folds, seed, key))
    if learner == "Naive Bayes":
        use = dealt.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> held")
        models = bayes.fit(use, features, label, [*by, "held"])
        scored = bayes.score(dealt.withColumn("held", F.col("fold")), models, features, [*by, "held"])
    else:
        scored = None
        groups = [dealt.where(" AND ".join(f"`{c}` <=> '{r[c]}'" for c in by)) for r in dealt.select(*by).distinct().collect()] if by else [dealt]
        for g in groups:
            for f in range(folds):
                part = learners.fit_score(learner, g.where(F.col("fold") != f), g.where(F.col("fold") == f), features, label)
                scored = part if scored is None else scored.unionByName(part)
    return M.with_measures(M.confusion(scored.withColumn("actual", F.col(label).cast("double")), by=by))


def earlier_versions(df: DataFrame, project: str, features: list[str], label: str, prefix: int = 3) -> DataFrame:
    """(test, measures): naive Bayes on each project, trained on those of its family with an earlier name."""
    pairs = R.earlier_versions(df, project, prefix)
    train = df.join(F.broadcast(pairs), df[project] == pairs["train"]).select("test", *features, label)  # a row a pair of projects
    models = bayes.fit(train, features, label, ["test"])
    scored = bayes.score(df.withColumn("test", F.col(project)), models, features, ["test"]).withColumn("actual", F.col(label).cast("double"))
    return M.with_measures(M.confusion(scored, by=["test"]))


def pca(df: DataFrame, features: list[str], variance: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained shares) of the fewest components above ``variance``: one aggregation of second moments, then a small eigenproblem on the driver (features squared)."""
    d = len(features)
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    vals, vecs = np.linalg.eigh(cov)
    vals, vecs = np.maximum(vals[::-1], 0), vecs[:, ::-1]
    vecs = vecs * np.where(vecs[np.abs(vecs).argmax(0), np.arange(d)] < 0, -1, 1)
    share = vals / max(vals.sum(), 1e-300)
    k = int(np.searchsorted(np.cumsum(share), variance, side="right")) + 1
    return np.array([sums[f"m{i}"] or 0.0 for i in range(d)]), vecs[:, : min(k, d)], share[: min(k, d)]


def apply_pca(df: DataFrame, features: list[str], mean: np.ndarray, components: np.ndarray, keep: list[str]) -> DataFrame:
    cols = [sum((F.col(f) - float(mean[i])) * float(components[i, k]) for i, f in enumerate(features)) for k in range(components.shape[1])]
    return df.select(*keep, *[c.alias(f"pc{k}") for k, c in enumerate(cols)])


def grow_features(df: DataFrame, ranked: list[str], label: str, key: str, start: int = 3) -> list[str]:
    """Features in rank order while the pooled F of cross-validation grows; like the original rule it returns the last set tried."""
    best, n = -1.0, min(start, len(ranked))
    while True:
        f = cross_validation(df, ranked[:n], label, key, 10).first()["f"]
        if f <= best or n == len(ranked):
            return ranked[:n]
        best, n = f, n + 1


RESULTS = "map<string, map<string, struct<measures: map<string, array<double>>, confs: array<string>>>>"


def result_tree(experiments: DataFrame, results: str = "results") -> DataFrame:
    """(id, method, dataset, measure, run, value): the result JSON in long form; unreadable JSON gives no rows."""
    m = experiments.select("id", F.explode(F.from_json(results, RESULTS)).alias("method", "sets"))
    d = m.select("id", "method", F.explode("sets").alias("dataset", "r")).select("id", "method", "dataset", F.explode("r.measures").alias("measure", "values"))
    return d.select("id", "method", "dataset", "measure", F.posexplode("values").alias("run", "value"))


def violin(tree: DataFrame, digits: int = 6) -> DataFrame:
    """(method, measure, n, mean, median, lo, hi, place): spread per method and measure; place orders methods by median within the measure."""
    from pyspark.sql import Window

    s = tree.groupBy("method", "measure").agg(F.count("value").alias("n"), F.round(F.avg("value"), digits).alias("mean"), F.round(F.median("value"), digits).alias("median"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("measure").orderBy("median", "method")))


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """(method, dataset, kind, measure, value): result and confusion lines of an experiment log; other lines give no rows."""
    text = F.trim(R.replace_all(F.col(line)))
    conf = text.startswith("#CONF-TEST:")
    body = F.when(conf, F.regexp_replace(text, "^#CONF-TEST:", "")).otherwise(text)
    known = conf | text.rlike("^(GIS|LSH|FIXED|VAR|VR|FX)")
    cells = F.regexp_extract_all(body, F.lit(r"'(\w+)':\s*([-+0-9.eE]+)"), F.lit(0))
    rows = lines.where(known).select(F.split_part(body, F.lit(":"), F.lit(1)).alias("method"), F.split_part(body, F.lit(":"), F.lit(2)).alias("dataset"), F.when(conf, "conf").otherwise("measure").alias("kind"), F.explode(cells).alias("c"))
    return rows.select("method", "dataset", "kind", F.regexp_extract("c", r"'(\w+)'", 1).alias("measure"), F.expr("try_cast(trim(split_part(c, ':', 2)) AS double)").alias("value"))


class RejectTracker:
    """History of accepted and rejected datasets: the threshold follows the mean of the last scores."""

    def __init__(self, threshold: float = 0.0, window: int = 10):
        self.start = threshold
        self.window = window
        self.reset()

    def reset(self) -> None:
        self.threshold, self.scores, self.rejected = self.start, [], 0

    def accept(self, score: float) -> bool:
        ok = score >= self.threshold
        self.rejected += not ok
        self.scores = [*self.scores, score][-self.window :]
        self.threshold = max(self.start, sum(self.scores) / len(self.scores) if self.rejected else self.start)
        return ok


def run(datasets: DataFrame, project: str, features: list[str], label: str, methods: list[str], mode: str = "all", repeats: int = 1) -> DataFrame:
    """(method, dataset, run, measures): every project tested by each named learner trained on all others.

    ``mode``: ``all`` features, ``gain`` the top half by mutual information, ``pca`` components of 95 % of the
    variance. Fits run one after the other on the cluster; there are projects * methods * repeats of them.
    """
    names = [r[0] for r in datasets.select(project).distinct().orderBy(project).collect()]
    out = None
    for name in names:
        train, test = datasets.where(F.col(project) != name), datasets.where(F.col(project) == name)
        use = features
        if mode == "gain":
            use = [r["feature"] for r in V.mutual_information(train, features, label).orderBy(F.desc("mi"), "feature").limit(max(1, len(features) // 2)).collect()]
        elif mode == "pca":
            mean, comp, _ = pca(train, features)
            train, test = (apply_pca(x, features, mean, comp, [label]) for x in (train, test))
            use = [f"pc{k}" for k in range(comp.shape[1])]
        for method in methods:
            for k in range(repeats):
                scored = learners.fit_score(method, train, test, use, label).select(F.col(label).cast("double").alias("actual"), "score")
                row = M.with_measures(M.confusion(scored)).select(F.lit(method).alias("method"), F.lit(name).alias("dataset"), F.lit(k).alias("run"), "*")
                out = row if out is None else out.unionByName(row)
    return out
