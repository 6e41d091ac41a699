"""The same plans run on a table that uses the reference's own column names
(spaces and slashes included), through ``Roles``."""

import pytest

from tabstat.config import Roles
from tabstat.operators.profile import group_summary
from tabstat.plans.prepare import prepare

REF = Roles(
    key="row", seg_id="ID", district="Comuna", street="Calle", day="Fecha", start="Hora Inicio", end="Hora Fin",
    duration_text="n", x="X", y="Y", z="Z", rank="Ranking Regional", length="Largo km", speed="Velocidad km/h",
    x_num="X", y_num="Y", z_num="Z", rank_num="Ranking Regional", length_num="Largo km", speed_num="Velocidad km/h",
    dt_start="dt_inicio", dt_end="dt_fin", duration_min="duracion_min", label="TARGET_BIN",
    hour_sin="hora_sin", hour_cos="hora_cos", length_log1p="Largo_km_log1p", length_winsor="Largo_km_winsor",
)


def test_prepare_with_reference_names(spark):
    rows = [
        (1, "Maipú-1", " Maipú ", "Av. Uno", "14-03-2025", "23:30", "00:10", "", "-70.7", "-33.5", "0", "10", "0,3", "19.5"),
        (2, "Maipú-2", "Maipú", "nan", "14-03-2025", "07:00", "07:45", "45 min", "-70.6", "-33.4", "0", "20", "0.4", "25"),
        (3, "Ñuñoa-3", "Ñuñoa", "Av. Dos", "14-03-2025", "17:10", "18:00", "1,5 h", "-70.5", "-33.3", "0", "30", "0.5", "s/d"),
    ]
    cols = ["row", "ID", "Comuna", "Calle", "Fecha", "Hora Inicio", "Hora Fin", "n", "X", "Y", "Z",
            "Ranking Regional", "Largo km", "Velocidad km/h"]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" if c != "row" else "row long" for c in cols))
    df, rep = prepare(raw, REF)
    assert "Z" in rep.constant_columns and "Fecha" in rep.constant_columns
    got = {r["row"]: r for r in df.collect()}
    assert got[1]["duracion_min"] == pytest.approx(40.0)  # empty duration -> end - start over midnight
    assert got[2]["duracion_min"] == 45.0 and got[3]["duracion_min"] == 90.0
    assert got[1]["Largo km"] is None  # decimal comma is not a number
    assert got[1]["TARGET_BIN"] == "Alta" and got[3]["TARGET_BIN"] == "Normal"
    assert got[2]["Calle"] is None and got[1]["Comuna"] == "Maipú"
    out = {r["Comuna"]: r for r in group_summary(df, REF).collect()}
    assert out["Maipú"]["n_segments"] == 2 and out["Maipú"]["speed_mean"] == 22.25
