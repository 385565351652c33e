"""Jobs that run plugged-in functions or models over many rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codepairs.functions.labels import label_encode
from codepairs.functions.text import TOKEN, token_count
from codepairs.operators.metrics import binary_metrics, confusion_counts
from codepairs.operators.records import union_sets
from codepairs.operators.sampling import balanced_sample
from codepairs.session import scratch_path


# Training rows that one task may hold.
ROWS_PER_TASK = 5000


def _once(udf):
    """Keeps Catalyst from repeating a costly call, e.g. inside a filter it derives from a later explode."""
    return udf.asNondeterministic()


def token_counts(df: DataFrame, text: str = "text", out: str = "token_count", tokenizer: Callable | None = None) -> DataFrame:
    """Adds the number of tokens; ``tokenizer`` maps a pandas Series of texts to one of counts."""
    counter = _once(F.pandas_udf(tokenizer, T.IntegerType()))(F.col(text)) if tokenizer else token_count(F.col(text))
    return df.withColumn(out, counter)


def hashed_token_encoder(dim: int = 64) -> Callable:
    """Default encoder: how often each md5 bucket of a token occurs, whole text, in float32."""

    def make() -> Callable:
        import hashlib
        import re
        from functools import lru_cache

        import numpy as np

        pattern = re.compile(r"\w+|[^\w\s]")

        @lru_cache(maxsize=1_000_000)
        def slot(token: str) -> int:
            return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.empty((len(texts), dim), dtype=np.float32)
            for i, text in enumerate(texts):
                slots = np.fromiter(map(slot, pattern.findall(text)), dtype=np.int64)
                out[i] = np.bincount(slots, minlength=dim)
            return out

        return encode

    return make


def batch_embed(
    df: DataFrame, text: str = "text", out: str = "embedding", make_fn: Callable | None = None, batch_size: int = 64
) -> DataFrame:
    """Adds an embedding per text; ``make_fn`` loads the model once per Python worker, not once per row."""
    from pyspark.ml.functions import predict_batch_udf

    encode = predict_batch_udf(make_fn or hashed_token_encoder(), return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, _once(encode)(F.col(text)))


def batch_embed_pairs(df: DataFrame, source: str, target: str, encoders: dict[str, Callable], out: str, batch_size: int = 64) -> DataFrame:
    """Adds ``out``, a struct with the embeddings ``{encoder}-source`` and ``{encoder}-target`` of two texts, by one Python worker a task."""
    from pyspark.ml.functions import predict_batch_udf

    def make() -> Callable:
        loaded = {name: load() for name, load in encoders.items()}

        def encode(sources, targets):
            sides = {"source": sources, "target": targets}
            return {f"{name}-{side}": fn(texts) for name, fn in loaded.items() for side, texts in sides.items()}

        return encode

    fields = [T.StructField(f"{name}-{side}", T.ArrayType(T.FloatType())) for name in encoders for side in ("source", "target")]
    encode_both = _once(predict_batch_udf(make, return_type=T.StructType(fields), batch_size=batch_size))
    return df.withColumn(out, encode_both(F.col(source), F.col(target)))


def digest_token_encoder(dim: int = 8) -> Callable:
    """Default token encoder: the first bytes of a token's md5, scaled to -1..1, between a start and an end marker."""

    def make() -> Callable:
        import hashlib
        import re
        from functools import lru_cache

        import numpy as np

        pattern = re.compile(r"\w+|[^\w\s]")

        @lru_cache(maxsize=100_000)
        def row(token: str) -> np.ndarray:
            return (np.frombuffer(hashlib.md5(token.encode()).digest()[:dim], dtype=np.uint8) - 127.5).astype(np.float32) / 127.5

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [np.stack([row(t) for t in ("<s>", *pattern.findall(text), "</s>")]) for text in texts]

        return encode

    return make


TOKEN_CELLS = 4_000_000  # numbers that leave Python in one batch of token matrices


def _matrices(texts, encode, batch_size: int):
    """The token matrices of some texts at a time, in order, as ``(first text, matrices)`` of bounded size."""
    import numpy as np

    for start in range(0, len(texts), batch_size):
        first, held, cells = start, [], 0
        for i, matrix in enumerate(encode(texts[start : start + batch_size]), start):
            matrix = np.asarray(matrix, dtype=np.float32)
            if held and cells + matrix.size > TOKEN_CELLS:
                yield first, held
                first, held, cells = i, [], 0
            held.append(matrix)
            cells += matrix.size
        if held:
            yield first, held


def batch_encode_tokens(
    df: DataFrame, text: str = "text", out: str = "tokens", make_fn: Callable | None = None, batch_size: int = 64
) -> DataFrame:
    """Adds the token matrix of each text, one row per token, whole text.

    ``make_fn`` loads the encoder once per task; it maps a list of texts to a
    list of matrices. Results leave Python in batches cut by the numbers they
    hold, since a matrix is far larger than its text; one text is always one row.
    """
    load = make_fn or digest_token_encoder()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = load()
        for batch in batches:
            for start, matrices in _matrices(batch.column(text).to_pylist(), encode, batch_size):
                part = batch.slice(start, len(matrices))
                rows = np.cumsum([0] + [len(m) for m in matrices]).astype(np.int32)
                widths = [m.shape[1] for m in matrices for _ in range(len(m))]
                cells = np.cumsum([0, *widths])
                if cells[-1] >= 1 << 31:
                    raise ValueError("the token matrix of one text has more numbers than a batch can hold")
                flat = np.concatenate([m.ravel() for m in matrices])
                tokens = pa.ListArray.from_arrays(pa.array(rows), pa.ListArray.from_arrays(pa.array(cells.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns, tokens], names=[*part.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.FloatType())))])
    return df.mapInArrow(run, schema)


def batch_encode_pooled(
    df: DataFrame, text: str = "text", out: str = "embedding", pooling: str = "cls", make_fn: Callable | None = None, batch_size: int = 64
) -> DataFrame:
    """Adds one vector per text, pooled from its token matrix inside the batch, so no matrix leaves Python.

    ``cls`` is the first row; ``mean`` and ``max`` leave out the first and last
    row and are NULL for fewer than 3 rows.
    """
    if pooling not in ("cls", "max", "mean"):
        raise ValueError(f"unknown pooling: {pooling}")
    load = make_fn or digest_token_encoder()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pool(matrix):
            if pooling == "cls":
                return matrix[0] if len(matrix) else None
            inner = matrix[1:-1]
            if not len(inner):
                return None
            return inner.max(axis=0) if pooling == "max" else inner.mean(axis=0, dtype=np.float64)

        encode = load()
        for batch in batches:
            for start, matrices in _matrices(batch.column(text).to_pylist(), encode, batch_size):
                part = batch.slice(start, len(matrices))
                vectors = pa.array([pool(m) for m in matrices], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)


def length_rule(centre: float, scale: float) -> Callable:
    """Default classifier: logistic in the length of the text."""

    def make() -> Callable:
        import numpy as np

        def classify(texts: np.ndarray) -> dict[str, np.ndarray]:
            sizes = np.array([len(t) for t in texts], dtype=np.float64)
            positive = 1 / (1 + np.exp(-np.clip((sizes - centre) / scale, -500, 500)))
            return {
                "label": np.where(positive >= 0.5, "POSITIVE", "NEGATIVE"),
                "score": np.maximum(positive, 1 - positive),
            }

        return classify

    return make


def batch_classify(
    df: DataFrame, classifiers: dict[str, Callable], text: str = "text", batch_size: int = 64
) -> DataFrame:
    """Adds ``{T}-inference`` (1/0) and ``{T}-score`` (of the predicted class) for each node type.

    Each entry of ``classifiers`` loads its model once per Python worker. All
    types are predicted by one call, so a text crosses to Python once. Models
    too large to be held together belong in separate calls.
    """
    from pyspark.ml.functions import predict_batch_udf

    def make() -> Callable:
        loaded = [load() for load in classifiers.values()]

        def classify(texts):
            out = {}
            for i, predict in enumerate(loaded):
                found = predict(texts)
                out[f"label{i}"], out[f"score{i}"] = found["label"], found["score"]
            return out

        return classify

    fields = [
        field
        for i in range(len(classifiers))
        for field in (T.StructField(f"label{i}", T.StringType()), T.StructField(f"score{i}", T.DoubleType()))
    ]
    predict = _once(predict_batch_udf(make, return_type=T.StructType(fields), batch_size=batch_size))
    columns: dict[str, Column] = {}
    for i, t in enumerate(classifiers):
        columns[f"{t}-inference"] = label_encode(F.col(f"_found.label{i}"))
        columns[f"{t}-score"] = F.col(f"_found.score{i}")
    return df.withColumn("_found", predict(F.col(text))).withColumns(columns).drop("_found")


def _classifier(features: int, regularisation: float):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="sentence", outputCol="_tokens", pattern=TOKEN, gaps=False, toLowercase=False),
            HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=features),
            LogisticRegression(featuresCol="_features", labelCol="label", regParam=regularisation, maxIter=20),
        ]
    )


def _stored(model, path: str):
    """The fitted pipeline with its classifier stored and loaded again, which leaves the training summary behind.

    The summary holds the session, and a session that has observed metrics cannot be sent to tasks.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegressionModel

    *stages, classifier = model.stages
    classifier.write().save(path)
    return PipelineModel([*stages, LogisticRegressionModel.load(path)])


def train_classifiers(
    train: DataFrame,
    valid: DataFrame,
    node_types: Sequence[str],
    use_size: int,
    id_col: str,
    text_col: str = "text",
    seed: int = 42,
    features: int = 4096,
    candidates: Sequence[float] = (0.1, 0.01),
    save_root: str | None = None,
) -> tuple[dict, DataFrame]:
    """One binary model per node type, and the validation metrics of the model kept.

    Training and validation rows are balanced samples of ``use_size`` at most.
    Of the candidate models of a type, the one with the best validation accuracy
    is kept and, given ``save_root``, stored at ``save_root/{type}``.
    """
    fit_rows = balanced_sample(train, node_types, use_size, id_col, text_col, seed).persist()
    check_rows = balanced_sample(valid, node_types, use_size, id_col, text_col, seed + 1)
    schema = (
        "node_type string, reg_param double, true_negative bigint, false_positive bigint, false_negative bigint,"
        " true_positive bigint, accuracy double, precision double, recall double, f1_score double"
    )
    # A sample has use_size rows per type at most, so its fit needs few tasks, and each of its many steps is short.
    tasks = max(1, use_size // ROWS_PER_TASK)
    # At most one row per node type.
    present = {r["node_type"] for r in fit_rows.select("node_type").distinct().collect()}

    def fit(node_type: str, regularisation: float):
        rows = fit_rows.filter(F.col("node_type") == node_type).select("sentence", "label").coalesce(tasks)
        return _stored(_classifier(features, regularisation).fit(rows), scratch_path(train.sparkSession, "classifier"))

    fitted = {
        (t, c): fit(t, c)
        for t in node_types
        if t in present
        for c in candidates
    }
    fit_rows.unpersist()
    if not fitted:
        return {}, train.sparkSession.createDataFrame([], schema)

    check_rows = check_rows.persist()
    checked = union_sets(
        *[
            model.transform(check_rows.filter(F.col("node_type") == t)).select(
                "node_type", F.lit(c).alias("reg_param"), F.col("label").alias("actual"), F.col("prediction").cast("int").alias("pred")
            )
            for (t, c), model in fitted.items()
        ]
    )
    # One row per node type and candidate.
    reports = binary_metrics(confusion_counts(checked, ["node_type", "reg_param"])).collect()
    check_rows.unpersist()
    rank = {(r["node_type"], r["reg_param"]): (r["accuracy"], -candidates.index(r["reg_param"])) for r in reports}
    models, kept = {}, []
    for t in dict.fromkeys(t for t, _ in fitted):
        best = max(candidates, key=lambda c: rank.get((t, c), (0.0, -candidates.index(c))))
        models[t] = fitted[t, best]
        kept.extend(r for r in reports if (r["node_type"], r["reg_param"]) == (t, best))
        if save_root:
            models[t].write().overwrite().save(f"{save_root}/{t}")
    return models, train.sparkSession.createDataFrame([tuple(r) for r in kept], schema)


def classify_with(models: dict, df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``{T}-inference`` and ``{T}-score`` from trained models."""
    from pyspark.ml.functions import vector_to_array

    rows = df.withColumn("sentence", F.col(text_col))
    for node_type, model in models.items():
        scored = model.transform(rows).withColumns(
            {
                f"{node_type}-inference": F.col("prediction").cast("int"),
                f"{node_type}-score": F.array_max(vector_to_array("probability")),
            }
        )
        rows = scored.drop("_tokens", "_features", "rawPrediction", "probability", "prediction")
    return rows.drop("sentence")
