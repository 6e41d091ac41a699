"""Report tables and findings text, built from the small result tables of
the profile and model steps (no row-sized data reaches the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Roles

# Section titles and the fixed sentences of the findings text.
SECTION_FINDINGS = "Hallazgos:"
SECTION_LIMITS = "Limitaciones:"
SECTION_ADVICE = "Recomendaciones:"
FIXED_LIMITS = [
    "- Los modelos lineales pueden no capturar relaciones no lineales o interacciones complejas.",
    "- No se incorporaron variables externas (clima, eventos), lo que puede limitar la generalización.",
]
FIXED_ADVICE = [
    "- Incorporar nuevas variables temporales (día de la semana, festivos) y condiciones climáticas.",
    "- Explorar modelos no lineales (árboles, gradient boosting) y validación temporal/espacial.",
    "- Realizar seguimiento continuo y recalibración con datos más recientes para capturar cambios de movilidad.",
]

# Sentences of the findings text.
COEFFICIENT_LINE = "- {label} {verb} a %s con coeficiente %.3f (p=%s)."
CORRELATION_LINE = "- Correlación destacada entre %s y %s: %.2f."
PEAK_LINE = ("- Velocidad promedio en periodo ", ": ", " km/h.")
SLOWEST_LINE = ("- La comuna con menor velocidad promedio es ", " (", " km/h).")
MISSING_LINE = ("- Existen valores faltantes en ", ".")

# Wording of the diagnostics text and of the report's notes.
HC1_LINE = "Errores estándar robustos HC1 utilizados para la inferencia."
NORMALITY_LINE = "Prueba de normalidad ({test}): estadístico={stat} p-value={p}"
BREUSCH_PAGAN_LINE = "Breusch-Pagan: LM p-value={lm} | F p-value={f}"
SHOWN_NOTE = "Coeficientes mostrados: {label} (fuente: {source})."
HOUR_NOTES = {True: "'hora_central' fue eliminada tras usar codificación cíclica (hora_sin, hora_cos).",
              False: "'hora_central' no estuvo disponible para la codificación cíclica."}
LENGTH_NOTES = {True: "'Largo km' se excluyó del modelado; se utiliza únicamente 'Largo_km_log1p'.",
                False: "'Largo km' permanece en el modelado por falta de transformación alternativa."}
FEATURES_LINE = "• Variables empleadas → num: {num}, cat (OHE): {cat}."
METRIC_NAMES = ("RMSE", "R2", "MAE", "Bias")
METRIC_LINE = "• {name}: {value:.3f}"
SOURCE_LINES = {"ols": "• Coeficientes estimados con OLS y errores HC1.", "ridge": "• Se recurrió a Ridge ante problemas de OLS."}

LINES_SCHEMA = "section string, ord long, text string"


def _lines(spark: SparkSession, section: str, texts: list[str], start: int = 0) -> DataFrame:
    return spark.createDataFrame([(section, start + i, t) for i, t in enumerate(texts)], LINES_SCHEMA)


def coefficient_lines(coef: DataFrame, model_label: str, verb: str, k: int = 5) -> DataFrame:
    """'- Modelo N <verb> a X con coeficiente c (p=p).' for the k largest
    |coef| without the constant."""
    top = top_coefficients(coef, k)
    p = F.when(F.col("p_value").isNull() | F.isnan("p_value"), F.lit("nan")).otherwise(
        F.format_string("%.3f", F.col("p_value")))
    text = F.format_string(COEFFICIENT_LINE.format(label=model_label, verb=verb),
                           F.col("variable"), F.col("coef"), p)
    return top.select(F.lit("findings").alias("section"), F.col("rank").cast("long").alias("ord"), text.alias("text"))


def top_coefficients(coef: DataFrame, k: int = 5) -> DataFrame:
    """Coefficients without the constant, by |coef| desc (then name), top k."""
    w = Window.orderBy(F.abs("coef").desc(), F.col("variable"))
    # coefficient tables have one row per feature (small): a plain window is fine
    return (coef.where((F.col("variable") != "const") & F.col("coef").isNotNull())
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def findings(spark: SparkSession, corr_pairs: DataFrame, peak_means: DataFrame, slowest: DataFrame,
             missing: DataFrame, coef_lines: list[DataFrame] | None = None, roles: Roles = Roles()) -> DataFrame:
    """(section, line_no, text). Inputs are the small result tables of the
    profile (correlation pairs, mean speed by peak label, slowest district,
    missing report) and optional coefficient lines of the models."""
    parts = [_lines(spark, "findings", [SECTION_FINDINGS], 0)]
    base = 100
    for i, cl in enumerate(coef_lines or []):
        parts.append(cl.withColumn("ord", F.col("ord") + F.lit(base * (i + 1))))
    wc = Window.orderBy(F.abs("corr").desc(), F.col("var1"), F.col("var2"))
    corr = corr_pairs.withColumn("r", F.row_number().over(wc)).where(F.col("r") <= 5)
    parts.append(corr.select(F.lit("findings").alias("section"), (F.col("r") + F.lit(1000)).cast("long").alias("ord"),
                             F.format_string(CORRELATION_LINE, "var1", "var2", "corr").alias("text")))
    wp = Window.orderBy(F.col(roles.peak))
    parts.append(peak_means.withColumn("r", F.row_number().over(wp)).select(
        F.lit("findings").alias("section"), (F.col("r") + F.lit(2000)).cast("long").alias("ord"),
        F.concat(F.lit(PEAK_LINE[0]), F.col(roles.peak), F.lit(PEAK_LINE[1]),
                 F.col("speed_mean").cast("string"), F.lit(PEAK_LINE[2])).alias("text")))
    parts.append(slowest.select(
        F.lit("findings").alias("section"), F.lit(3000).cast("long").alias("ord"),
        F.concat(F.lit(SLOWEST_LINE[0]), F.col(roles.district), F.lit(SLOWEST_LINE[1]),
                 F.col("speed_mean").cast("string"), F.lit(SLOWEST_LINE[2])).alias("text")))
    parts.append(_lines(spark, "limits", [SECTION_LIMITS], 0))
    miss = missing.where(F.col("n_missing") > 0).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.format_string("%s (%d)", "variable", "n_missing").alias("t")))).alias("a"))
    parts.append(miss.where(F.size("a") > 0).select(
        F.lit("limits").alias("section"), F.lit(1).cast("long").alias("ord"),
        F.concat(F.lit(MISSING_LINE[0]), F.array_join(F.transform("a", lambda s: s["t"]), ", "),
                 F.lit(MISSING_LINE[1])).alias("text")))
    parts.append(_lines(spark, "limits", FIXED_LIMITS, 10))
    parts.append(_lines(spark, "advice", [SECTION_ADVICE] + FIXED_ADVICE, 0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("section").orderBy("ord")  # a handful of lines per section
    return out.select("section", F.row_number().over(w).alias("line_no"), "text")


def _number(value, digits: int) -> str:
    return "nan" if value is None or value != value else f"{value:.{digits}f}"


def diagnostic_lines(diagnostics: dict) -> list[str]:
    """The diagnostics text of one model (empty without diagnostics, as after
    a ridge fit)."""
    if not diagnostics:
        return []
    d = diagnostics
    return [
        HC1_LINE,
        NORMALITY_LINE.format(test=d["normality_test"], stat=_number(d["normality_stat"], 4), p=_number(d["normality_p"], 5)),
        BREUSCH_PAGAN_LINE.format(lm=_number(d["bp_lm_pvalue"], 5), f=_number(d["bp_f_pvalue"], 5)),
    ]


REPORT_SCHEMA = "part string, ord int, name string, value double, p_value double, std_err double, text string"


def report_rows(run, data_profile: list[tuple[str, int]], columns: list[str], roles: Roles = Roles()) -> list[tuple]:
    """The report's tables of a regression run in one long form, see
    ``REPORT_SCHEMA``:

    * vif: the 15 largest, by size;
    * coefficients: the 10 largest |coef| of the first model fitted by least
      squares (model 2 before 1, else model 2), without the constant;
    * notes: text lines;
    * data: rows, columns, numeric and other columns;
    * modelo1, modelo2: the 8 largest |coef|, with p-values and HC1 errors
      only where they come from least squares, and the text lines beside them
      (modelo1_text, modelo2_text).
    """
    rows: list[tuple] = []

    def add(part, entries):
        rows.extend((part, i, *e) for i, e in enumerate(entries, 1))

    def largest(result, k):
        table = [r for r in result.table_rows() if r[0] != "const" and r[1] is not None]
        return sorted(table, key=lambda r: (-abs(r[1]), r[0]))[:k]

    def cut(value, digits):
        return None if value is None else round(value, digits)

    models = {"Modelo 1": run.ols1, "Modelo 2": run.ols2}
    label = next((m for m in ("Modelo 2", "Modelo 1") if models[m].source == "ols"), "Modelo 2")
    add("vif", [(c, round(v, 2), None, None, None) for c, v in sorted(run.vif, key=lambda t: (-round(t[1], 6), t[0]))[:15]])
    add("coefficients", [(v, round(b, 3), cut(p, 4), None, None) for v, b, _, p, _ in largest(models[label], 10)])
    notes = [SHOWN_NOTE.format(label=label, source=models[label].source), HOUR_NOTES[roles.hour_sin in columns], LENGTH_NOTES[roles.length_log1p in columns]]
    add("notes", [(None, None, None, None, t) for t in notes])
    add("data", [(name, float(n), None, None, None) for name, n in data_profile])
    metrics = {m[0]: m[1:] for m in run.metrics}
    for part, result in (("modelo1", run.ols1), ("modelo2", run.ols2)):
        ols = result.source == "ols"
        add(part, [(v, round(b, 4), cut(p, 4) if ols else None, cut(se, 4) if ols else None, None) for v, b, se, p, _ in largest(result, 8)])
        lists = run.data.lists
        lines = [FEATURES_LINE.format(num=len(lists.numeric), cat=len(lists.categorical))]
        lines += [METRIC_LINE.format(name=n, value=v) for n, v in zip(METRIC_NAMES, metrics[part])]
        add(f"{part}_text", [(None, None, None, None, t) for t in [*lines, SOURCE_LINES["ols" if ols else "ridge"]]])
    return rows
