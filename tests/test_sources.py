import pytest
from pyspark.sql import functions as F

from tessara.operators import hierarchy
from tessara.sources import facts, hierarchy_csv, panel

LEVELS = [("All", 0, 1), ("Area", 1, 3), ("Leaf", 3, 8)]
NAMES = ["All", "hill", "dale", "['hill', 1]", "hill.2", "hill-3", "dale 4", "dale/5"]


def _files(path, names=NAMES):
    quoted = [f'"{n}"' for n in names]
    values = lambda b: [sum(b), sum(b[:3]), sum(b[3:]), *b]
    data = [",".join(["", *quoted])] + [",".join([f"2020-0{m}-01", *map(str, values([m, 7, 2.5 * m, m * m, 9 - m]))]) for m in range(1, 6)]
    matrix = [[1] * 5, [1, 1, 1, 0, 0], [0, 0, 0, 1, 1]] + [[int(i == j) for j in range(5)] for i in range(5)]
    rows = [",".join(["", *(f'"{n}"' for n in NAMES[3:])])] + [",".join([f'"{n}"', *(f"{w}.0" for w in m)]) for n, m in zip(NAMES, matrix, strict=True)]
    (path / "data.csv").write_text("\n".join(data))
    (path / "agg.csv").write_text("\n".join(rows))
    return str(path / "data.csv"), str(path / "agg.csv")


def test_hierarchies_from_two_files(spark, tmp_path):
    h = hierarchy_csv.read_hierarchy(spark, *_files(tmp_path), LEVELS, end_date="2020-04-01")
    assert (h.obs.count(), h.stored.count(), h.edges.count(), h.calendar.count()) == (20, 12, 15, 4)
    assert hierarchy.check_identity(h.nodes, h.edges).count() == 0
    assert hierarchy.verify_coherence(h.obs, h.edges, h.stored).count() == 0
    assert {r.node_id: r.level for r in h.nodes.collect()}["['hill', 1]"] == "Leaf"


def test_names_must_agree(spark, tmp_path):
    with pytest.raises(ValueError, match="names"):
        hierarchy_csv.read_hierarchy(spark, *_files(tmp_path, [NAMES[1], NAMES[0], *NAMES[2:]]), LEVELS)


def test_fact_logs_and_day_columns(spark, tmp_path):
    (tmp_path / "train.csv").write_text("id,date,store_nbr,item_nbr,unit_sales,onpromotion\n1,2020-01-01,3,9,1.5,\n2,2020-01-02,3,9,2,True\n")
    rows = facts.read_facts(spark, str(tmp_path / "train.csv"))
    assert rows.columns == ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"] and [r.onpromotion for r in rows.orderBy("date").collect()] == [None, True]
    with pytest.raises(ValueError, match="lacks"):
        facts.read_csv(spark, str(tmp_path / "train.csv"), facts.STORES)
    wide = spark.createDataFrame([("i", "s", 1, 2)], "item_id string, store_id string, d_1 int, d_2 int")
    calendar = spark.sql("SELECT concat('d_', id + 1) AS d, date_add(DATE '2020-01-01', CAST(id AS INT)) AS ds, CAST(id AS INT) AS t FROM range(3)")
    assert [(r.t, r.y) for r in facts.unpivot_days(wide, ["item_id", "store_id"], calendar).orderBy("t").collect()] == [(0, 1.0), (1, 2.0)]
    assert facts.preferred_path(spark, [str(tmp_path / "none.csv"), str(tmp_path / "train.csv")]).endswith("train.csv")
    with pytest.raises(FileNotFoundError):
        facts.preferred_path(spark, [str(tmp_path / "none.csv")])


def test_panels_are_written_and_read(spark, tmp_path):
    h = hierarchy_csv.read_hierarchy(spark, *_files(tmp_path), LEVELS)
    panel.write_panel({"obs": h.obs, "nodes": h.nodes, "edges": h.edges, "calendar": h.calendar}, str(tmp_path / "built"))
    got = panel.read_panel(spark, str(tmp_path / "built"))
    assert got["obs"].columns == h.obs.columns and got["obs"].exceptAll(h.obs).count() == 0 and got["obs"].count() == h.obs.count()
    with pytest.raises(FileNotFoundError, match="edges"):
        panel.read_panel(spark, str(tmp_path), ("edges",))


def test_results_are_written(spark, tmp_path):
    scores = spark.createDataFrame([(0, "Total", 0.1), (1, "Total", 0.3), (0, "Bottom", 0.2)], "seed int, level string, scrps double")
    table, by_seed = panel.write_results(scores, str(tmp_path))
    rows = {r.level: r for r in spark.read.csv(table, header=True, inferSchema=True).collect()}
    assert abs(rows["Total"]["mean"] - 0.2) < 1e-9 and abs(rows["Total"]["std"] - 0.1) < 1e-9 and rows["Bottom"]["n"] == 1
    assert spark.read.json(by_seed).where(F.col("seed") == 1).count() == 1
