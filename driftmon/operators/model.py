"""Text features and the classifier, as Spark ML pipelines.

The reference fine-tunes neural models on one GPU; here the same roles are
played by distributed Spark ML stages: tokenise -> hashed term frequencies
-> IDF -> logistic regression (or naive Bayes).  A user's own encoder or
classifier can be plugged in as an Arrow-batched ``predict_batch_udf``
(``user_encoder_udf``), so the monitoring jobs do not depend on the model.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, IndexToString, Normalizer, RegexTokenizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.sources.scratch import written

TOKEN_PATTERN = r"\W+"


def tokenizer(input_col: str = "text", output_col: str = "tokens") -> RegexTokenizer:
    return RegexTokenizer(inputCol=input_col, outputCol=output_col, pattern=TOKEN_PATTERN,
                          toLowercase=True, minTokenLength=1, gaps=True)


def tokenize_text(df: DataFrame, text_col: str = "text", max_tokens: int | None = None) -> DataFrame:
    """Lower-cased word tokens of the whole text; ``max_tokens`` truncates only when asked."""
    out = tokenizer(text_col, "tokens").transform(df.fillna("", [text_col]))
    if max_tokens:
        out = out.withColumn("tokens", F.slice("tokens", 1, int(max_tokens)))
    return out


def embedding_pipeline(text_col: str = "text", dim: int = 512) -> Pipeline:
    """Text -> unit-length TF-IDF vector of ``dim`` hashed dimensions."""
    return Pipeline(stages=[
        tokenizer(text_col, "_tokens"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_vec", p=2.0),
    ])


def embed_text(fit_on: DataFrame, df: DataFrame, text_col: str = "text", dim: int = 512,
               out_col: str = "embedding") -> DataFrame:
    """Fit the IDF on ``fit_on`` (the training text) and embed ``df`` as ``array<double>``."""
    model = embedding_pipeline(text_col, dim).fit(fit_on.fillna("", [text_col]))
    out = model.transform(df.fillna("", [text_col]))
    return out.withColumn(out_col, vector_to_array("_vec")).drop("_tokens", "_tf", "_tfidf", "_vec")


def user_encoder_udf(make_predict_fn, dim: int, batch_size: int = 32):
    """Wrap a user's batch encoder (texts -> float matrix) as an Arrow-batched UDF."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size,
                             input_tensor_shapes=[[]])


def classifier_pipeline(text_col: str = "text", label_col: str = "label", model_type: str = "logistic",
                        num_features: int = 1 << 18, max_iter: int = 50) -> Pipeline:
    """Tokenise, hash, IDF, index labels alphabetically, fit the classifier, map ids back."""
    indexer = StringIndexer(inputCol=label_col, outputCol="_label_id", stringOrderType="alphabetAsc",
                            handleInvalid="error")
    if model_type == "logistic":
        clf = LogisticRegression(featuresCol="_features", labelCol="_label_id", predictionCol="_pred_id",
                                 maxIter=max_iter, regParam=0.01)
    elif model_type == "naive_bayes":
        clf = NaiveBayes(featuresCol="_features", labelCol="_label_id", predictionCol="_pred_id")
    else:
        raise ValueError("model_type must be 'logistic' or 'naive_bayes'")
    return Pipeline(stages=[
        tokenizer(text_col, "_tokens"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        indexer,
        clf,
    ])


def fit_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                   model_type: str = "logistic", **kw) -> PipelineModel:
    """Fit on the labelled rows; rows without a label teach nothing and are left out here only.

    Their texts and labels are written once: the stages read them one after the
    other, and the number of tasks follows the bytes they hold.
    """
    known = train.where(F.col(label_col).isNotNull()).fillna("", [text_col])
    known = written(known.select(text_col, label_col), "fit-rows")
    return classifier_pipeline(text_col, label_col, model_type, **kw).fit(known)


def score_classifier(model: PipelineModel, df: DataFrame, text_col: str = "text", label_col: str = "label",
                     pred_col: str = "y_pred", true_col: str = "y_true") -> DataFrame:
    """Predict a class for every row (null text counts as ''), names back via the fitted label index.

    The label indexer takes no part in scoring, so rows whose label is null,
    unknown to the model or missing altogether are scored like all others.
    """
    indexer = next(s for s in model.stages if isinstance(s, StringIndexerModel))
    scorer = PipelineModel(stages=[s for s in model.stages if s is not indexer])
    back = IndexToString(inputCol="_pred_id", outputCol=pred_col, labels=indexer.labels)
    out = back.transform(scorer.transform(df.fillna("", [text_col])))
    return out.withColumnRenamed(label_col, true_col).drop(
        "_tokens", "_tf", "_features", "_pred_id", "rawPrediction", "probability")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
