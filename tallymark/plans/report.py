"""Text report of a trained model as ordered rows ``(section_no, section, line_no, text)``.

The metrics table of one model has tens of rows; it is turned into a map and the lines are
formatted from it on the JVM side. A line whose values are missing is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.operators.estimators import Spec
from tallymark.operators.metrics import improvement

# Label and metric of each line per family, in report order.
_LINES = {
    "logistic": [("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1 Score", "f1"),
                 ("ROC-AUC", "roc_auc"), ("Log Loss", "log_loss")],
    "poisson": [("Poisson Deviance", "poisson_deviance"), ("Pseudo-R2", "pseudo_r2"), ("MSE", "mse"), ("RMSE", "rmse"),
                ("MAE", "mae")],
    "other": [("R2", "r2"), ("Adjusted R2", "adj_r2"), ("MSE", "mse"), ("RMSE", "rmse"), ("MAE", "mae")],
}
_RATIOS = {
    "logistic": [("Accuracy", "accuracy"), ("ROC-AUC", "roc_auc"), ("F1 Score", "f1")],
    "poisson": [("Poisson Deviance", "poisson_deviance"), ("MSE", "mse"), ("MAE", "mae")],
    "other": [("MSE", "mse"), ("MAE", "mae")],
}
_PRIMARY = {"logistic": "ROC-AUC", "poisson": "Poisson Deviance", "other": "MSE"}


def _value(split: str, metric: str) -> Column:
    return F.element_at("m", f"{split}.{metric}")


def _line(label: str, value: Column, form: str = "%.4f") -> Column:
    return F.when(value.isNotNull(), F.format_string(f"  {label + ':':<20}{form}", value))


def report_lines(
    metrics: DataFrame, spec: Spec, when: str, best: bool = False, folds: int = 10, features: int | None = None,
) -> DataFrame:
    """Report rows of one model from its tidy metrics ``(model, split, fold, metric, value)``."""
    kind = spec.family if spec.family in _LINES else "other"
    own = metrics.where((F.col("model") == spec.name) & F.col("fold").isNull() & F.col("value").isNotNull())
    values = own.agg(F.map_from_entries(F.collect_list(  # one model: tens of entries
        F.struct(F.concat_ws(".", "split", "metric"), F.col("value")))).alias("m"))

    sections: list[tuple[str, list[Column]]] = []
    title = spec.family.upper() + (" (log target)" if spec.log_label else "")
    head = [F.lit(f"MODEL REPORT: {spec.name}"), F.lit(f"MODEL TYPE: {title}"), F.lit(f"Timestamp: {when}")]
    sections.append(("header", ([F.lit("BEST MODEL")] if best else []) + head))
    if spec.params:
        sections.append(("hyper-parameters", [F.lit(f"  {k}: {v}") for k, v in sorted(spec.params.items())]))
    listed = [F.lit(f"PREDICTORS ({len(spec.predictors)}): {', '.join(spec.predictors)}")]
    if features is not None:
        listed.append(F.lit(f"Encoded features: {features}"))
    sections.append(("predictors", listed))
    sections.append((f"cross-validation ({folds} folds)", [_line(t, _value("cv", m)) for t, m in _LINES[kind]]))
    if spec.log_label:
        sections.append(("cross-validation, original scale", [
            _line(t, _value("cv", f"{m}_original")) for t, m in (("MSE", "mse"), ("RMSE", "rmse"), ("MAE", "mae"))]))
    sections.append(("test set", [_line(t, _value("test", m)) for t, m in _LINES[kind]]))
    if kind == "logistic":
        base = lambda m: _value("baseline", m)
        gain = lambda m: F.when(base(m) != 0, improvement(_value("test", m), base(m)))
        shown = [("Accuracy", "accuracy"), ("F1 Score", "f1"), ("ROC-AUC", "roc_auc")]
        sections.append(("majority baseline", [
            F.when(base("majority_class").isNotNull(), F.format_string("  Always class %d", base("majority_class").cast("int"))),
            *[_line(t, base(m)) for t, m in shown],
            *[F.when(gain(m).isNotNull(), F.format_string(f"  {t + ' gain:':<20}%+.2f%%", gain(m))).when(
                base(m) == 0, F.lit(f"  {t + ' gain:':<20}N/A")) for t, m in shown]]))
    ratio = lambda m: F.when(_value("cv", m) != 0, _value("test", m) / _value("cv", m))
    sections.append(("generalisation (test / cv)", [_line(t, ratio(m)) for t, m in _RATIOS[kind]]))
    if spec.log_label:
        sections.append(("test set, original scale", [
            _line(t, _value("test", f"{m}_original")) for t, m in (
                ("Mean", "pred_mean"), ("MSE", "mse"), ("RMSE", "rmse"), ("MAE", "mae"), ("R2", "r2"), ("Adjusted R2", "adj_r2"))
        ] + [F.format_string("  Pred Range: [%.2f, %.2f]", _value("test", "pred_min_original"), _value("test", "pred_max_original"))]))
    if kind != "logistic":
        r2, adj = _value("test", "r2"), _value("test", "adj_r2")
        sections.append(("additional metrics", [
            _line("R2 Score", r2), _line("Adjusted R2", adj),
            *[_line(t, _value("test", m), "%.2f") for t, m in (
                ("Mean Actual", "actual_mean"), ("Mean Predicted", "predicted_mean"), ("Actual Range", "actual_range"),
                ("Predicted Range", "predicted_range"))]]))
        sections.append(("interpretation", [
            F.when(r2.isNotNull(), F.format_string("  The model explains %.1f%% of the variance", r2 * 100)),
            F.when(adj.isNotNull(), F.format_string("  Allowing for its complexity: %.1f%%", adj * 100)),
            F.format_string("  Predictions range from %.2f to %.2f", _value("test", "predicted_min"), _value("test", "predicted_max")),
            F.format_string("  Actual values range from %.2f to %.2f", _value("test", "actual_min"), _value("test", "actual_max"))]))
        sections.append(("warnings", [
            F.when(r2 < 0.1, F.format_string("  WARNING: very low R2 (%.4f)", r2)),
            F.when((ratio("mse") > 1.2) | (ratio("mae") > 1.2), F.format_string(
                "  WARNING: possible overfitting, MSE ratio %.2f, MAE ratio %.2f", ratio("mse"), ratio("mae")))]))
    if best:
        sections.append(("best", [F.lit(f"This is the best model by cross-validated {_PRIMARY[kind]}")]))

    entries = [
        F.struct(F.lit(s).alias("section_no"), F.lit(name).alias("section"), F.lit(i).alias("line_no"), text.alias("text"))
        for s, (name, lines) in enumerate(sections) for i, text in enumerate(lines)]
    rows = values.select(F.explode(F.array(*entries)).alias("r")).select("r.*")
    return rows.where(F.col("text").isNotNull()).orderBy("section_no", "line_no")
