"""Jobs: the compositions a user calls (one lazy plan each where possible)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmon.operators import cleaning, distribution, windows
from driftmon.operators.collections import select_collections

PREPARE_STEPS = ("export", "clean", "map")


def prepare_issues(docs: DataFrame, steps=PREPARE_STEPS, collections=None, keys=("project",),
                   remove_invalid_dates: bool = True, remove_duplicates: bool = True,
                   on_missing: str = "raise") -> DataFrame:
    """Export (flatten + printable), clean (dates, duplicates), map labels.

    Any subset of the steps in the given order; an unknown step is an error.
    ``docs`` is the nested document frame for ``export``, else a flat frame.
    """
    unknown = [s for s in steps if s not in PREPARE_STEPS]
    if unknown:
        raise ValueError(f"unknown step(s): {unknown}")
    df = docs
    if collections:
        df, _ = select_collections(df, collections, on_missing=on_missing)
    for step in steps:
        if step == "export":
            df = cleaning.flatten_fields(df, keys=keys)
        elif step == "clean":
            df = cleaning.clean_issues(df, keys, remove_invalid_dates, remove_duplicates)
        else:
            df = cleaning.map_labels(df)
    return df


def build_windows(mapped: DataFrame, split_type: str, range_size: int, path: str | None = None,
                  on_bad_date: str = "drop") -> DataFrame:
    """Windows of the mapped issues; written partitioned when ``path`` is given."""
    from driftmon.sources.issues_io import write_windows

    w = windows.create_time_windows(mapped, split_type, range_size, on_bad_date=on_bad_date)
    if path:
        write_windows(w, path)
    return w


def distribution_tables(mapped: DataFrame, mode: str, split_type: str | None = None,
                        range_size: int | None = None) -> DataFrame:
    """``overall``: one row per project + total; ``windows``: per project and window + totals."""
    if mode == "overall":
        return distribution.overall_distribution(mapped)
    if mode == "windows":
        if not split_type or not range_size:
            raise ValueError("windows mode requires split_type and range_size")
        return distribution.window_distribution(windows.create_time_windows(mapped, split_type, range_size))
    raise ValueError("mode must be 'overall' or 'windows'")


def monitor_classifier(windows_df: DataFrame, target, split_type: str, keys=("project",), labels=None,
                       model=None, model_type: str = "logistic", rule: str = "evaluation",
                       sampling: str | None = None, samples_per_class: int = 50, seed: int = 42,
                       id_col: str | None = None, model_path: str | None = None):
    """Train on the range (or reuse ``model``), score later windows, report per window.

    ``sampling`` cuts the training rows (few-shot runs); without ``id_col``,
    as cleaned issues have none, rows are ordered by their content.  Returns ``(report, predictions, model)``; ``model_path`` saves the fitted model.
    With a model to fit, the rows of the range and after it are written once for both sides.
    """
    from driftmon.operators import model as M
    from driftmon.operators import report as R
    from driftmon.operators.sampling import sample_training_data
    from driftmon.sources.scratch import written

    if model is None:
        windows_df = written(windows.train_and_test_windows(windows_df, target, split_type, rule), "monitored-windows")
        train = windows.load_model_frame(windows_df, target, split_type, labels=labels, require_rows=True)
        if sampling:
            train = sample_training_data(train, sampling, label_col="label", id_col=id_col,
                                         n=samples_per_class, seed=seed, keys=keys)
        model = M.fit_classifier(train, model_type=model_type)
        if model_path:
            M.save_model(model, model_path)
    test = windows.load_model_frame(windows_df, target, split_type, test=True, rule=rule, labels=labels)
    scored = M.score_classifier(model, test)
    return R.report_by_window(scored, keys), scored, model


def monitor_projects(texts: DataFrame, ranges: DataFrame, split_type: str, keys=("project",), labels=None,
                     rule: str = "evaluation", text_col: str = "text", label_col: str = "label",
                     id_col: str | None = None, candidates=None, **fit_options):
    """A range and a model per key: all fitted in one job, every later window of each key scored and reported.

    ``texts`` are windowed rows, ``ranges`` has a row per key (``train_start``,
    ``train_end``).  With ``candidates`` each key's regularisation is chosen on
    its validation rows.  Returns ``(report, predictions, model, curve)``; the
    curve is None without candidates.
    """
    from driftmon.operators import keyed_model as K
    from driftmon.operators import report as R

    known = windows.filter_label_set(texts, labels, label_col)
    train = windows.train_windows_by_key(known, ranges, keys)
    test = windows.test_windows_by_key(known, ranges, split_type, keys, rule)
    if candidates:
        model, curve = K.fit_validated(train, keys, text_col, label_col, id_col, candidates, **fit_options)
    else:
        model, curve = K.fit_keyed(train, keys, text_col, label_col, **fit_options), None
    scored = K.score_keyed(model, test, text_col, label_col)
    return R.report_by_window(scored, keys), scored, model, curve


def monitor_similarity(train_vectors: DataFrame, test_vectors: DataFrame, mode: str = "mean",
                       keys=("project",), id_col: str = "vec_id", include_distribution: bool = True,
                       exact: bool = True) -> DataFrame:
    """Similarity of every test window to the training vectors, one row per (keys, window)."""
    from driftmon.operators import similarity as SIM

    return SIM.similarity_by_period(test_vectors, train_vectors, mode, keys, id_col=id_col,
                                    include_distribution=include_distribution, exact=exact)


def monitor_text_similarity(texts: DataFrame, target, split_type: str, keys=("project",), mode: str = "mean",
                            validation: float = 0.3, sampling: str | None = "balanced", samples_per_class: int = 50,
                            seed: int = 42, rule: str = "similarity", dim: int = 512, text_col: str = "text",
                            label_col: str = "label", id_col: str | None = None, period_col: str = "period",
                            include_distribution: bool = True) -> DataFrame:
    """Similarity of every later window's text to the training text, one row per (keys, window).

    The range's rows without their validation share (``validation``, 0 keeps
    all), cut by ``sampling``, are the training text.  One encoder is fitted on
    it and applied to it and to every test row.
    """
    from driftmon.operators import model as M
    from driftmon.operators import sampling as SA
    from driftmon.operators import similarity as SIM
    from driftmon.sources.scratch import written

    keys = list(keys)
    named = [label_col, *([id_col] if id_col else [])]
    train = windows.train_windows(texts, target, period_col).select(*dict.fromkeys([*keys, period_col, text_col, *named]))
    if validation:
        split = SA.train_validation_split(train, label_col, id_col, validation, seed, keys)
        train = split.where("split = 'train'").drop("split")
    if sampling:
        train = SA.sample_training_data(train, sampling, label_col=label_col, id_col=id_col,
                                        n=samples_per_class, seed=seed, keys=keys)
    test = windows.test_windows(texts, target, split_type, rule, period_col)
    columns = [*keys, period_col, text_col]
    train = written(train.select(*columns), "similarity-train")
    both = train.withColumn("_part", F.lit("train")).unionByName(test.select(*columns).withColumn("_part", F.lit("test")))
    embedded = written(M.embed_text(train, both, text_col, dim).drop(text_col), "similarity-vectors")
    sides = {p: embedded.where(F.col("_part") == p).drop("_part").withColumn("vec_id", F.lit(0)) for p in ("train", "test")}
    return SIM.similarity_by_period(sides["test"], sides["train"], mode, keys, period_col,
                                    include_distribution=include_distribution)


def relate_similarity_to_quality(similarity: DataFrame, report: DataFrame, keys=("project",),
                                 use_deltas: bool = False, normalize: bool = True, split_type: str = "month"):
    """Pair the series, then normality, the automatic correlation test, DTW and (month) yearly tests.

    Returns a dict of DataFrames: ``paired``, ``normality``, ``correlation``, ``dtw``, ``yearly``.
    """
    from driftmon.operators import dtw as D
    from driftmon.operators import report as R
    from driftmon.operators import series as SE
    from driftmon.operators import stats as ST

    keys = list(keys)
    paired = SE.join_similarity_performance(similarity, R.macro_f1_series(report, keys), keys)
    x, y = "similarity", "f1_macro"
    if use_deltas:
        paired = SE.period_deltas(paired, [x, y], keys)
        x, y = f"{x}_delta", f"{y}_delta"
    dtw_x, dtw_y = x, y  # DTW restarts from the raw (or delta) columns
    if normalize:
        paired = SE.minmax_scale(paired, [x, y], keys)
        x, y = f"{x}_normalized", f"{y}_normalized"
    out = {
        "paired": paired,
        "normality": ST.check_normality(paired, [x, y], keys),
        "correlation": ST.auto_correlation_test(paired, x, y, keys),
        "dtw": D.dtw_align(paired, dtw_x, dtw_y, keys),
    }
    if split_type == "month":
        out["yearly"] = ST.yearly_correlation(paired, x, y, keys)
    return out


def performance_timeline(report: DataFrame, keys=("project",)) -> DataFrame:
    """Macro F1 per window placed on a decimal-year axis, sorted."""
    from driftmon.operators import report as R

    return R.performance_timeline(R.macro_f1_series(report, keys), keys).orderBy(*keys, "decimal_date")
