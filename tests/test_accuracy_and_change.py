"""Published results of the confusion and transition matrices."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import accuracy as ac, change as ch

CM = [[98, 0, 0, 0], [0, 77, 4, 11], [0, 0, 68, 6], [0, 15, 13, 61]]
WEIGHTS = [0.0010, 0.9395, 0.0179, 0.0417]
MATRIX = [
    [12.67191924016621, 2.5383406959533685, 3.1534409652709967, 5.794001014799216],
    [41.265320447026426, 5555.023000808764, 1116.6428476391918, 2073.473428223214],
    [6.862256975914409, 58.99754516667697, 154.99244561947225, 121.65075011516466],
    [4.846437462615965, 307.3753925300705, 157.48647809255044, 558.0405032818836],
]
BUILT_UP = {2018: 1342.0, 2020: 1178.3, 2022: 1026.7, 2024: 2756.8, 2026: 2625.1}


@pytest.fixture(scope="module")
def cm(spark):
    rows = [(i, j, n) for i, r in enumerate(CM) for j, n in enumerate(r)]
    return spark.createDataFrame(rows, "ref int, pred int, n bigint")


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame(list(enumerate(WEIGHTS)), "class int, w double")


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(i, j, x) for i, r in enumerate(MATRIX) for j, x in enumerate(r)]
    return spark.createDataFrame(rows, "from_class int, to_class int, ha double")


def test_overall_accuracy(cm):
    r = ac.overall_accuracy(cm).first()
    assert r.oa == pytest.approx(0.8611898016997167)
    assert r.kappa == pytest.approx(0.8146266705248155)


def test_class_accuracy(cm):
    rows = {r["class"]: r for r in ac.class_accuracy(cm).collect()}
    assert rows[1].producers_accuracy == pytest.approx(77 / 92)
    assert rows[3].consumers_accuracy == pytest.approx(61 / 78)


def test_area_weighted(cm, weights):
    r = ac.area_weighted_accuracy(cm, weights).first()
    assert r.oa_weighted == pytest.approx(0.8322669730016661)
    assert r.se == pytest.approx(0.03644074109918524)
    assert (r.ci95_low, r.ci95_high) == pytest.approx((0.760843120447263, 0.9036908255560692))
    c = {x["class"]: x for x in ac.area_weighted_classes(cm, weights).collect()}
    assert [c[i].user_weighted for i in range(4)] == pytest.approx(
        [1.0, 0.9911412352285608, 0.25949362711795493, 0.2007596348532574])
    assert [c[i].estimated_proportion for i in range(4)] == pytest.approx(
        [0.000999900009999, 0.7932694151200416, 0.06338114785677455, 0.14234953701318498])


def test_class_area_confidence(cm, weights):
    r = ac.class_area_confidence(cm, weights, 10222.1).first()
    assert r.p_hat == pytest.approx(0.14234953701318498)
    assert r.margin95_ha == pytest.approx(641.5837984010263)
    assert r.ci95_low_ha == pytest.approx(813.5274039014519)


def test_empty_class_counts_as_zero(spark):
    cm = spark.createDataFrame([(0, 0, 5), (0, 1, 1)], "ref int, pred int, n bigint")
    rows = {r["class"]: r for r in ac.class_accuracy(cm).collect()}
    assert rows[1].producers_accuracy == 0.0 and rows[1].consumers_accuracy == 0.0


def test_transition(matrix):
    s = ch.transition_summary(matrix).first()
    assert s.total_ha == pytest.approx(10180.814108278735)
    assert s.changed_pct == pytest.approx(38.30819616043294)
    flows = ch.transition_flows(matrix, top=6).collect()
    assert flows[0].flow == "Vegetation → Built-up" and flows[0].ha == pytest.approx(2073.473428223214)
    assert len(flows) == 6
    g = ch.gain_loss(matrix).first()
    assert g.gain_ha == pytest.approx(5.794001 + 2073.473428 + 121.65075)
    assert g.net_ha == pytest.approx(g.gain_ha - g.loss_ha)
    totals = {(r.from_class, r.to_class): r.ha for r in ch.transition_totals(matrix).collect()}
    assert totals[-1, -1] == pytest.approx(10180.814108278735) and len(totals) == 25


def test_significance(spark):
    area = spark.createDataFrame(list(BUILT_UP.items()), "year int, ha double")
    rows = {r.period: r for r in ch.change_significance(area, 641.5837984010263).collect()}
    assert rows["2022 → 2024"].significant and rows["2022 → 2024"].ratio == pytest.approx(1.9067897992121257)
    assert sum(r.significant for r in rows.values()) == 1
    assert rows["2018 → 2020"].margin_diff_ha == pytest.approx(907.3365090975772)
    zero = ch.change_significance(area, 0.0).first()
    assert zero.ratio == float("inf")


def test_transition_from_maps(spark):
    a = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 3)], "row int, col int, class int")
    b = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (2, 0, 3)], "row int, col int, class int")
    m = {(r.from_class, r.to_class): r.ha for r in ch.transition_matrix(a, b).collect()}
    assert len(m) == 16 and m[1, 3] == m[1, 1] == pytest.approx(0.01) and sum(m.values()) == pytest.approx(0.02)
    area = spark.createDataFrame([(2022, 0, 0, 1), (2022, 0, 1, 1)], "year int, row int, col int, class int")
    t = {r["class"]: r for r in ch.class_area_table(area).collect()}
    assert t[1].area_pct == 100.0 and t[3].n == 0
