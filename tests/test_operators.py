"""Operators on hand-made inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitreon import constants as C
from vitreon.operators import composition as K
from vitreon.operators import graph, jobs, longruns, neighbors, placement, potentials, series, structure, voxels
from vitreon.schemas import ATOMS, FRAMES
from vitreon.sources import trajectories as T


def make(spark, atoms, cell):
    a = spark.createDataFrame([("s", 0, i + 1, z, *map(float, p)) for i, (z, p) in enumerate(atoms)], ATOMS)
    f = spark.createDataFrame([("s", 0, *map(float, np.array(cell).ravel()))], FRAMES)
    return a, f


def cube(n):
    return [[n, 0, 0], [0, n, 0], [0, 0, n]]


def found(a, f, r, **k):
    return {(x.i, x.j): x.d2**0.5 for x in neighbors.pairs(a, f, r, **k).collect()}


def test_neighbors_in_a_cube(spark):
    a, f = make(spark, [(8, (0.5, 0, 0)), (14, (1.5, 0, 0)), (8, (3.5, 0, 0)), (14, (4.5, 0, 0))], cube(6))
    assert set(found(a, f, 1.5)) == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert set(found(a, f, 2.0)) == {(1, 2), (2, 1), (3, 4), (4, 3), (2, 3), (3, 2), (1, 4), (4, 1)}
    assert set(found(a, f, 2.0, half=True)) == {(1, 2), (3, 4), (2, 3), (1, 4)}
    ls = {r.atom_id: r.neighbors for r in neighbors.lists(a, neighbors.pairs(a, f, 1.5, centers=[14])).collect()}
    assert ls == {1: [], 2: [1], 3: [], 4: [3]}


def test_neighbor_across_a_face(spark):
    a, f = make(spark, [(14, (0.5, 5, 5)), (8, (9.5, 5, 5))], cube(10))
    got = neighbors.pairs(a, f, 2.0).where("i = 1").first()
    assert got.d2 == pytest.approx(1.0) and got.dx == pytest.approx(-1.0)


def test_sheared_cell_has_true_distances(spark):
    cell = [[5, 0, 0], [2, 5, 0], [0, 0, 5]]
    a, f = make(spark, [(14, (0.1, 0.1, 0.1)), (8, (1.1, 0.1, 0.1)), (8, (2.1, 4.9, 0.1))], cell)
    got = found(a, f, 2.0)
    assert got[1, 2] == pytest.approx(1.0)
    assert got[1, 3] == pytest.approx(math.hypot(0.0, 0.2))


@pytest.mark.parametrize("r", [1.0, 2.6, 4.0, 5.0])
def test_pairs_equal_brute_force_for_few_cells(spark, r):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 10, (60, 3))
    a, f = make(spark, [(8, x) for x in p], cube(10))
    d = p[None] - p[:, None]
    d -= 10 * np.rint(d / 10)
    want = {(i + 1, j + 1) for i, j in zip(*np.nonzero((d**2).sum(-1) <= r * r), strict=True) if i != j}
    assert set(found(a, f, r)) == want


def test_pair_cutoffs():
    t = neighbors.pair_cutoffs({(8, 14): 2.0, (8, 8): 3.0}, [8, 14])
    assert dict(((a, b), v) for a, b, v in t) == {(8, 8): 3.0, (8, 14): 2.0, (14, 8): 2.0, (14, 14): 3.0}


def test_too_small_a_cell(spark):
    _, f = make(spark, [(8, (0, 0, 0))], cube(1.5))
    with pytest.raises(ValueError):
        structure.clamped_r_max(f, 5.0)


def test_angle_and_qn(spark):
    # a chain Si-O-Si with a free oxygen
    a, f = make(spark, [(14, (3, 5, 5)), (8, (4.6, 5, 5)), (14, (6.2, 5, 5)), (8, (3, 6.6, 5)), (8, (9, 9, 9))], cube(20))
    p = neighbors.pairs(a, f, 1.9)
    o = {r.atom_id: r.o_class for r in structure.oxygen_classes(a, p, [14]).collect()}
    assert o == {2: "BO", 4: "NBO", 5: "free"}
    q = {r.n: r["count"] for r in structure.qn(a, p, [14]).where("z is null").collect()}
    assert q == {0: 0, 1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}
    ang = structure.angles(p, 14, 8, 180).collect()
    assert len(ang) == 1 and ang[0].angle == pytest.approx(90.5)
    assert graph.former_edges(p, [14]).collect()[0][2:] == (1, 3)


def ring_sizes(spark, pairs, most):
    e = spark.createDataFrame([("s", 0, min(p), max(p)) for p in pairs], "structure_id string, frame int, u long, v long")
    return {r["size"]: r["n"] for r in graph.ring_histogram(graph.rings(e, most)).collect()}


def test_rings(spark):
    assert ring_sizes(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (1, 4)], 10) == {3: 1, 4: 1}
    assert ring_sizes(spark, [(0, 1), (1, 2), (0, 2), (0, 3), (2, 3)], 10) == {3: 2}
    assert ring_sizes(spark, [(i, (i + 1) % 8) for i in range(8)], 6) == {}


def comp(spark, c):
    return spark.createDataFrame([("c", i, o, float(v)) for i, (o, v) in enumerate(c.items())], "comp_id string, pos int, oxide string, amount double")


def test_density(spark):
    d = K.density(K.extract(comp(spark, {"SiO2": 80, "Na2O": 20}))).first().density
    assert d == pytest.approx(2.391, abs=0.01)
    assert K.density(K.extract(comp(spark, {"SiO2": 80, "Cu2O": 20}))).first().density is None


@pytest.mark.parametrize(("target", "kind"), [(100, "molecules"), (325, "atoms")])
def test_plan(spark, target, kind):
    p = K.plan(comp(spark, {"CaO": 0.25, "Al2O3": 0.25, "SiO2": 0.5}), target, kind)
    assert {r.element: r.atoms for r in K.element_counts(p).collect()} == {"Ca": 25, "Al": 50, "Si": 50, "O": 200}


def test_canonical_round_trip(spark):
    c = comp(spark, {"Na2O": 15.0, "CaO": 15.004, "SiO2": 69.5})
    s = K.canonical(c)
    assert s.first().canonical == "CaO 15 - Na2O 15 - SiO2 69.5"
    assert {r.oxide: r.amount for r in K.from_canonical(s).collect()} == {"CaO": 15.0, "Na2O": 15.0, "SiO2": 69.5}


def test_neutral(spark):
    df = spark.createDataFrame([(f,) for f in ("SiO2", "NaO3", "Fe2O3", "FeO", "O2", "Xx2O")], "formula string")
    got = {r.formula: r.neutral for r in K.neutral(df).collect()}
    assert got == {"SiO2": True, "NaO3": False, "Fe2O3": True, "FeO": True, "O2": False, "Xx2O": False}


def test_potential_lines(spark):
    e = spark.createDataFrame([("c", x) for x in ("Si", "O", "Na")], "comp_id string, element string")
    lines = potentials.config(e, "pmmcs").first()
    assert lines.species == ["Na", "O", "Si"]
    assert "group Na type 1" in lines.config and "set type 2 charge -1.2" in lines.config
    assert "pair_coeff 3 2 pedone 0.340554 2.0067 2.1 1.0" in lines.config
    assert potentials.config(e, "bjp").count() == 0  # no sodium there
    with pytest.raises(ValueError):
        potentials.config(e, "other")


def test_moduli(spark):
    rows = [("g", i, j, 70.0 if i == j and i < 4 else 20.0 if i == j else 30.0) for i in range(1, 7) for j in range(1, 7) if i == j or (i < 4 and j < 4)]
    m = series.moduli(spark.createDataFrame(rows, "id string, i int, j int, c double")).first()
    assert m.bulk == pytest.approx(130 / 3) and m.shear == pytest.approx(20.0)
    assert m.young == pytest.approx(9 * m.bulk * m.shear / (3 * m.bulk + m.shear))


def test_series_pieces():
    x = np.random.default_rng(1).normal(size=50)
    a = series.autocorrelation(x, 10)
    assert np.allclose(a, [np.mean(x[: 50 - k] * x[k:]) for k in range(10)])
    assert series.divisor_near(100, 7) == 5 and series.divisor_near(0, 3) is None
    t = np.arange(1000.0, 2000.0, 100.0)
    p, _ = series.levenberg(lambda q: q[0] + q[1] / (t - q[2]) - (-3 + 5000 / (t - 500)), np.array([0.0, 1000.0, 300.0]), np.array([-np.inf, 0, 0]), np.array([np.inf, np.inf, 999.0]))
    assert np.allclose(p, [-3, 5000, 500], rtol=1e-3)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_running_mean(spark, n):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(6)], "run string, t int, y double")
    got = [r["mean"] for r in series.running_mean(df, ["run"], "t", "y", n).orderBy("t").collect()]
    y = [float(i * i) for i in range(6)]
    for i in range(6):
        w = range(i - n // 2, i + n - n // 2)
        assert got[i] == (pytest.approx(np.mean([y[k] for k in w])) if w[0] >= 0 and w[-1] < 6 else None)


def test_viscosity_is_positive(spark):
    rng = np.random.default_rng(5)
    y = np.zeros((3, 800))
    for k in range(1, 800):
        y[:, k] = 0.8 * y[:, k - 1] + rng.normal(size=3)
    rows = [("r", i, 3000.0, 8000.0, *y[:, i].tolist()) for i in range(800)]
    th = spark.createDataFrame(rows, "run_id string, step long, temperature double, volume double, pxy double, pxz double, pyz double")
    assert series.viscosity(th, 1000.0).first().viscosity > 0
    assert series.viscosity(th, 1000.0, "helfand").first().viscosity > 0
    assert series.viscosity(th.where("step < 1"), 1.0).first().viscosity is None


def test_bulk_viscosity(spark):
    """The trace's autocorrelation, product by product; shears and their order of rows don't matter."""
    rng = np.random.default_rng(6)
    p = rng.normal(size=(60, 6)) + 2
    rows = [("r", i, 3000.0, 8000.0, *p[i].tolist()) for i in rng.permutation(60).tolist()]
    th = spark.createDataFrame(rows, "run_id string, step long, temperature double, volume double, pxx double, pyy double, pzz double, pxy double, pxz double, pyz double")
    x = (p[:, 0] + p[:, 1] + p[:, 2]) * 1e9
    x -= x.mean()
    c = [sum(x[i] * x[i + k] for i in range(60 - k)) / (60 - k) for k in range(30)]
    want = 8000e-30 / (9 * 1.380649e-23 * 3000) * sum((a + b) / 2 * 2e-15 for a, b in zip(c[:-1], c[1:], strict=True))
    assert series.viscosity(th, 2.0, "helfand").first().bulk_viscosity == pytest.approx(want)
    assert series.viscosity(th.drop("pzz"), 2.0, "helfand").first().bulk_viscosity is None


def test_first_minimum():
    r = np.linspace(0.01, 5, 500)
    g = 3 * np.exp(-(((r - 1.6) / 0.1) ** 2)) + 1.5 * np.exp(-(((r - 3.2) / 0.4) ** 2))
    assert 1.8 < structure.first_minimum(r, g) < 2.6
    assert structure.first_minimum(r[:5], g[:5]) is None


def test_cavity_between_walls(spark):
    pts = [(8, (x, y, z)) for x in np.arange(0, 12, 1.0) for y in np.arange(0, 12, 1.0) for z in np.arange(0, 12, 1.0) if (x - 6) ** 2 + (y - 6) ** 2 + (z - 6) ** 2 > 9]
    a, f = make(spark, pts, cube(12))
    c = voxels.cavities(a, f, 1.0, 40).collect()
    assert len(c) == 1 and 10 < c[0].volume < 90 and c[0].anisotropy < 0.1


def test_labels_by_flood():
    e = np.zeros((6, 6, 6), bool)
    e[0, 0, 0] = e[1, 1, 1] = e[5, 5, 5] = True
    lab = voxels.label(e)
    assert lab[0, 0, 0] == lab[1, 1, 1] != lab[5, 5, 5] and lab.max() == 2


def test_placement_keeps_the_distance():
    p = placement.place([30, 30], 12.0, 1.6, 7, 10_000)
    d = p[None] - p[:, None]
    d -= 12 * np.rint(d / 12)
    assert ((d**2).sum(-1) + 1e9 * np.eye(60)).min() >= 1.6**2
    with pytest.raises(RuntimeError):
        placement.place([500], 3.0, 1.6, 1, 50)


def test_job_versions(spark):
    rows = [("a", 1, "pending"), ("a", 2, "running"), ("b", 1, "completed")]
    df = spark.createDataFrame(rows, "job_id string, version long, status string")
    assert {(r.job_id, r.status) for r in jobs.latest(df, ["job_id"], [F.col("version")]).collect()} == {("a", "running"), ("b", "completed")}
    assert jobs.cancel(df, "a").first().status == "cancelled" and jobs.cancel(df, "b").count() == 0
    assert jobs.append(df, "zzz", {"status": "x"}).count() == 0


def test_runtime_text(spark):
    df = spark.createDataFrame([(5.0,), (90.0,), (7200.0,)], "s double").select(jobs.runtime_text(F.col("s")).alias("t"))
    assert [r.t for r in df.collect()] == ["5.0 s", "1.5 min", "2.0 h"]


DUMP = "".join(
    f"ITEM: TIMESTEP\n{10 * k}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n-1 9\nITEM: ATOMS id type x y z\n1 1 {k} 0 0\n2 2 5 5 5\n" for k in range(5)
)


def test_dump(spark, tmp_path):
    p = tmp_path / "t.dump"
    p.write_text(DUMP)
    a, f = T.read_dump(spark, str(p), {1: "Si", 2: "O"})
    assert {(r.frame, r.x) for r in a.where("atom_id = 1").collect()} == {(k, float(k)) for k in range(5)}
    assert f.count() == 5 and f.first().c00 == 10.0
    assert a.where("atom_id = 2").first().z == 6.0  # the box begins at -1
    some, _ = T.read_dump(spark, str(p), {1: "Si", 2: "O"}, start=1, stop=5, step=2)
    assert {r.frame for r in some.collect()} == {1, 3}
    last, _ = T.last_frame(a, f)
    assert {r.frame for r in last.collect()} == {4}
    with pytest.raises(Exception, match="element"):
        T.read_dump(spark, str(p))[0].collect()


@pytest.mark.parametrize("fmt", ["xyz", "extxyz", "cif", "poscar"])
def test_texts(spark, tmp_path, fmt):
    a, f = make(spark, [(14, (0, 0, 0)), (8, (1.6, 0, 0))], cube(8))
    t = T.to_text(a, f, fmt)
    text = t.first().text
    assert "Si" in text and "O" in text
    if fmt == "xyz":
        assert text.split("\n")[2] == "Si 0.00000000 0.00000000 0.00000000"
    T.write_text(t, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        T.to_text(a, f, "pdb")


def test_symbols(spark):
    assert T.symbols_to_z({("Si", "O"): 2.0, ("Na", "O"): -1.0}) == ({(14, 8): 2.0}, [14])
    e = spark.createDataFrame([("O",), ("Si",)], "element string")
    assert {(r.a, r.b): r.length for r in graph.bond_lengths(e, {("Si", "O"): 2.0}).collect()} == {("O", "O"): -1.0, ("O", "Si"): 2.0, ("Si", "Si"): -1.0}


def test_constants():
    assert len(C.SYMBOLS) == 118 and C.Z["Og"] == 118
    assert len(C.DENSITY_TERMS) + 2 == 101


def test_job_store(spark, tmp_path):
    from vitreon.sources.jobstore import JobStore, deserialize, serialize

    s = JobStore(spark, str(tmp_path / "jobs"))
    rows = [("a", "h1", "SiO2 100", "pmmcs", "pending"), ("b", "h1", "SiO2 100", "shik", "running"), ("c", "h2", "SiO2 100", "pmmcs", "completed")]
    s.create(spark.createDataFrame(rows, "job_id string, request_hash string, composition string, potential string, status string"))
    s.update("b", status="completed", result_data='{"structure": 1, "cte": 2}', elemental_vector=[0.5, 0.5])
    s.update("nobody", status="failed")
    assert s.jobs().count() == 3 and s.get("b").first().version == 2
    assert s.find_completed_by_hash("h1").first().job_id == "b" and s.find_completed_by_hash("h2").count() == 0
    assert {r.job_id for r in s.search_by_composition("SiO2 100").collect()} == {"b", "c"}
    assert s.search_by_composition("SiO2 100", "shik").count() == 1
    assert s.list_compositions().first().n_jobs == 2 and s.completed_vectors().first().elemental_vector == [0.5, 0.5]
    assert s.cancel("a") and not s.cancel("c") and s.get("a").first().status == "cancelled"
    s.set_tags("c", ["z", "a", "z"])
    got = {r.job_id: r.tags for r in s.tags(spark.createDataFrame([("a",), ("c",)], "job_id string")).collect()}
    assert got == {"a": [], "c": ["a", "z"]}
    assert {tuple(r.missing) for r in s.lookup("SiO2 100", ["cte", "viscosity"]).collect()} <= {("viscosity",), ("cte", "viscosity")}
    s.clear_results("h1")
    assert s.find_completed_by_hash("h1").count() == 0
    with pytest.raises(ValueError):
        s.update("a", status="odd")
    a = spark.createDataFrame([("s", 0, 2, "O", 1.0, 0.0, 0.0), ("s", 0, 1, "Si", 0.0, 0.0, 0.0)], "structure_id string, frame int, atom_id long, element string, x double, y double, z double")
    back = deserialize(serialize(a))
    assert [(r.atom_id, r.element) for r in back.orderBy("atom_id").collect()] == [(1, "Si"), (2, "O")]
    assert deserialize(spark.createDataFrame([("s", 0, "no json")], "structure_id string, frame int, atoms string")).count() == 0


def test_analysis(spark):
    """A square of four corner-sharing formers: all oxygens bridge, every former has Q2, one ring of four."""
    from vitreon.plans.analyze import analyze, pair_class

    pts = [(14, (4, 4, 10)), (14, (7.2, 4, 10)), (14, (7.2, 7.2, 10)), (14, (4, 7.2, 10)), (8, (5.6, 4, 10)), (8, (7.2, 5.6, 10)), (8, (5.6, 7.2, 10)), (8, (4, 5.6, 10)), (11, (15, 15, 15))]
    a, f = make(spark, pts, cube(20))
    r = analyze(a, f, 9.0, 450).first()
    assert r.oxygen == {"BO": 4} and r.qn["2"] == 4 and r.connectivity == 2.0
    assert r.rings == {"4": 1} and r.angles == {"90": 4} or sum(r.angles.values()) == 4
    assert r.coordination["Si"] == {"2": 4} and r.coordination["Na"] == {"0": 1}
    assert r.elements == {"Si": "former", "O": "oxygen", "Na": "modifier"} and r.n_atoms == 9
    df = spark.createDataFrame([(8, 8), (8, 14), (11, 8), (14, 14)], "za int, zb int").select(pair_class().alias("c"))
    assert [x.c for x in df.collect()] == ["oo", "former", "modifier", None]


def test_wide_rows_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("g", 0, 2), ("g", 3, 5)], "comp string, cn int, n int")
    w = T.wide_histogram(df, "comp", "cn", "n", "Si", 4).first()
    assert (w.Si_0, w.Si_1, w.Si_3, w.Si_tot) == (2, 0, 5, 7)
    T.write_histogram(T.wide_histogram(df, "comp", "cn", "n", "Si", 4), str(tmp_path / "h"))
    T.write_pair_table(potentials.pair_table(spark, ("Si", "O"), n=100), "Si-O", str(tmp_path))
    lines = spark.read.text(str(tmp_path / "table_Si-O.tbl")).collect()
    assert lines[0].value == "SHIK_Buck_r24" and len(lines) == 103
    assert T.wide_curve(df.withColumn("v", F.col("n") * 0.5), "comp", "cn", "v", [0.5, 1.5, 2.5, 3.5]).first()["3.50"] == 2.5


def test_small_pieces(spark):
    from vitreon.functions import geometry as G

    d = spark.range(1).select(G.cubic_distance(F.lit(9.0), F.lit(0.5), F.lit(-1.0), F.lit(10.0)).alias("d")).first().d
    assert d == pytest.approx(math.sqrt(1 + 0.25 + 1))
    fits = spark.createDataFrame([("x", -2.0, 4000.0, 500.0), ("flat", 5.0, 4000.0, 500.0)], "id string, a double, b double, t0 double")
    got = {r.id: (r.t4, r.t7_6) for r in series.reference_temperatures(fits).collect()}
    assert got["x"] == (round(500 + 4000 / 6 - 273.15, 1), round(500 + 4000 / 9.6 - 273.15, 1)) and got["flat"][0] is None
    scan = spark.createDataFrame([("a", 300.0), ("a", 300.0), ("b", 300.0), ("b", 400.0)], "id string, temperature double")
    assert {r.id: (r.status, r.repeated) for r in series.scan_inputs(scan, ["id"]).collect()} == {"a": ("too few", True), "b": ("ok", False)}


def test_strain(spark):
    a, f = make(spark, [(8, (1.0, 2.0, 3.0))], cube(10))
    b, g = series.strained(a, f, [[0.01, 0, 0], [0, 0, 0.02], [0, 0.02, 0]])
    assert (b.first().x, b.first().y, b.first().z) == (pytest.approx(1.01), pytest.approx(2.06), pytest.approx(3.04))
    assert g.first().c00 == pytest.approx(10.1) and g.first().c12 == pytest.approx(0.2)


def test_flat_rdf_gives_flat_structure_factor(spark):
    a, f = make(spark, [(8, (i, 0, 0)) for i in range(4)] + [(14, (i, 5, 5)) for i in range(4)], cube(10))
    g = structure.rdf(a, f, 5.0, 50).withColumn("g", F.lit(1.0))
    s = structure.structure_factor(g, 1.0, 5.0, 5)
    assert all(r.s == pytest.approx(1.0) for r in s.collect())
    p = spark.createDataFrame([(8, [(3.0, 10.0)]), (14, [(6.0, 5.0)])], "atomic_number int, terms array<struct<a: double, b: double>>")
    w = structure.xray_form_factors(p, 1.0, 5.0, 5)
    q = (1.0 / (4 * math.pi)) ** 2
    assert w.where("k = 0 and atomic_number = 8").first().b == pytest.approx(8 - 41.78214 * q * 3 * math.exp(-10 * q))
    assert all(r.s == pytest.approx(1.0) for r in structure.structure_factor(g, 1.0, 5.0, 5, weights=w).collect())


def test_xyz_and_data_files(spark, tmp_path):
    a, f = make(spark, [(14, (0, 0, 0)), (8, (1.6, 0, 0))], cube(8))
    (tmp_path / "a.xyz").write_text(T.to_text(a, f, "extxyz").first().text + "\n")
    got = T.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("atom_id").collect()
    assert [(r.atom_id, r.element, r.x) for r in got] == [(1, "Si", 0.0), (2, "O", 1.6)]
    (tmp_path / "b.data").write_text("# made\n\n2 atoms\n2 atom types\n0 8 xlo xhi\n\nMasses\n\n1 22.99\n2 16.0\n\nAtoms  # atomic\n\n1 1 0.5 0 0\n2 2 1.5 2.5 3.5\n\nVelocities\n\n1 0 0 0\n2 0 0 0\n")
    got = T.read_data(spark, str(tmp_path / "b.data"), {1: "Na", 2: "O"}).orderBy("atom_id").collect()
    assert [(r.atom_id, r.element, r.x, r.z) for r in got] == [(1, "Na", 0.5, 0.0), (2, "O", 1.5, 3.5)]
    (tmp_path / "c.json").write_text('{"data": {"T": [300, 400], "V": [1.5, 2.5], "note": "text"}, "other": 1}')
    got = T.read_cte(spark, str(tmp_path / "c.json")).collect()
    assert {(r.series, r.i, r.value) for r in got} == {("T", 0, 300.0), ("T", 1, 400.0), ("V", 0, 1.5), ("V", 1, 2.5)}


def test_viscosity_outputs(spark):
    """Each output against its definition, lag by lag, for all cutoff methods and both formalisms."""
    rng = np.random.default_rng(11)
    n, dt, v, t = 400, 50.0, 9000.0, 2500.0
    y = np.zeros((n, 6))
    for k in range(1, n):
        y[k] = 0.9 * y[k - 1] + rng.normal(size=6)
    rows = [("r", i, t, v, *y[i].tolist()) for i in range(n)]
    th = spark.createDataFrame(rows, "run_id string, step long, temperature double, volume double, pxx double, pyy double, pzz double, pxy double, pxz double, pyz double")
    shear = y[:, 3:]
    corr = lambda x, lag: sum(x[i] * x[i + lag] for i in range(n - lag)) / (n - lag)
    for method in ("noise_threshold", "cumulative_integral", "self_consistent"):
        r = series.viscosity(th, dt, cutoff=method).first()
        lags = len(r.lag_time)
        c = np.array([[corr(shear[:, k], lag) for lag in range(lags)] for k in range(3)])
        scale = v * 1e-30 / (1.380649e-23 * t) * 1e18 * dt * 1e-15
        integral = [scale * np.mean([sum((c[k][i] + c[k][i + 1]) / 2 for i in range(m)) for k in range(3)]) for m in range(lags)]
        assert r.lag_time == pytest.approx([i * dt / 1000 for i in range(lags)]) and r.integral == pytest.approx(integral) and r.viscosity == pytest.approx(integral[-1])
        assert r.sacf == pytest.approx(list((c / c[:, :1]).mean(0))) and r.sacf[0] == pytest.approx(1) and r.tau >= 10
        assert r.window % 2 == 0 and int(n * dt / 1000) % (r.window // 2) == 0 and r.msd is None
    r = series.viscosity(th, dt, "helfand").first()
    chi = np.cumsum(shear * 1e9, axis=0) * dt * 1e-15
    msd = [2 * np.mean([corr(chi[:, k], 0) - corr(chi[:, k], lag) for k in range(3)]) for lag in range(1, n // 2 + 1)]
    assert r.msd == pytest.approx(msd) and len(r.lag_time) == len(msd) and r.integral is None
    assert r.mean_pressure == pytest.approx(y[:, :3].mean()) and r.fit_residual > 0 and r.viscosity == pytest.approx(r.slope * v * 1e-30 / (2 * 1.380649e-23 * t))
    with pytest.raises(ValueError):
        series.viscosity(th, dt, cutoff="other").collect()
    fit = series.fit_vft(spark.createDataFrame([("a", 1000.0 + 100 * i, -2.0 + 4000 / (700 + 100 * i) + 0.01 * (i % 3)) for i in range(9)], "id string, t double, l double"), ["id"], "t", "l").first()
    assert np.array(fit.covariance).shape == (3, 3) and (np.diag(fit.covariance) > 0).all()


def test_own_ranges(spark):
    """A tiny cell neither cuts the others' range nor stops them."""
    rows = [(s, 0, i, 8 if i % 2 else 14, x, x / 2, x / 3) for s in ("big", "tiny") for i, x in enumerate((0.1, 0.9, 1.3, 1.8))]
    a = spark.createDataFrame(rows, "structure_id string, frame int, atom_id bigint, atomic_number int, x double, y double, z double")
    cell = lambda e: [float(e) if i == j else 0.0 for i in range(3) for j in range(3)]
    f = spark.createDataFrame([("big", 0, *cell(20)), ("tiny", 0, *cell(1.5)), ("mid", 0, *cell(7))], "structure_id string, frame int, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3)))
    ranges = {r.structure_id: r.r_max for r in structure.with_r_max(f, 8.0).collect()}
    assert ranges == {"big": 8.0, "tiny": None, "mid": 3.0}
    got = structure.rdf(a, structure.with_r_max(f, 8.0), 8.0, 50)
    alone = structure.rdf(a, f.where("structure_id = 'big'"), 8.0, 50)
    key = lambda df: sorted(tuple(r) for r in df.select("structure_id", "za", "zb", "bin", "r", "g").collect())
    assert key(got) == key(alone)


def test_analysis_curves(spark, sf):
    from vitreon.plans import analyze, structures

    a = structures.atoms(spark, sf).where("structure_id < '3'")
    f = structures.frames(a)
    out = analyze.analyze(a, f, 5.0, 60, 36, 8, n_q=20)
    rows = {r.structure_id: r for r in out.collect()}
    g = structure.rdf(a, f, 5.0, 60)
    for x, name in (("neutron", "sq_neutron"), ("xray", "sq_xray")):
        s = structure.structure_factor(g, 0.5, 20.0, 20, radiation=x).where("za is null").orderBy("k").collect()
        for i, r in rows.items():
            assert list(r[name]) == pytest.approx([y.s for y in s if y.structure_id == i])
    for r in rows.values():
        assert len(r.q) == 20 and len(r.r) == 60 and all(len(v) == 60 for v in r.g.values())
        assert "O-Si" in r.g and {"O-Si", "Si-O"} <= set(r.cumulative) and "O-Si" in r.sq_partial
    out.release()
    with pytest.raises(ValueError):
        structure.structure_factor(g, radiation="electron")


def test_form_factors(spark):
    """At q = 0 a form factor is the number of electrons; it falls with q and is positive up to 10."""
    from vitreon.constants import XRAY_TERMS

    p = spark.createDataFrame([(z, [{"a": a, "b": b} for a, b in zip(v[::2], v[1::2], strict=True)]) for z, v in XRAY_TERMS.items()], "atomic_number int, terms array<struct<a: double, b: double>>")
    f = structure.xray_form_factors(p, 0.0, 10.0, 11)
    for z in XRAY_TERMS:
        b = [r.b for r in f.where(F.col("atomic_number") == z).orderBy("k").collect()]
        assert b[0] == pytest.approx(z) and all(x > y > 0 for x, y in zip(b, b[1:], strict=False))


def test_repeated_steps(spark, tmp_path):
    """Steps that stand again after a restart are frames of their own, in order of the file."""
    frame = lambda step, x: f"ITEM: TIMESTEP\n{step}\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type x y z\n1 1 {x} 0 0\n"
    (tmp_path / "a.dump").write_text("".join(frame(s, x) for x, s in enumerate((0, 100, 100, 200, 50))))
    (tmp_path / "b.dump").write_text("".join(frame(7, x) for x in range(3)))
    atoms, frames = T.read_dump(spark, str(tmp_path), {1: "Si"})
    rows = sorted((r.structure_id[-6:], r.frame, r.x) for r in atoms.collect())
    assert rows == [("a.dump", i, float(i)) for i in range(5)] + [("b.dump", i, float(i)) for i in range(3)]
    steps = sorted((r.structure_id[-6:], r.frame, r.step) for r in frames.collect())
    assert [s for p, _, s in steps if p == "a.dump"] == [0, 100, 100, 200, 50]
    some, _ = T.read_dump(spark, str(tmp_path / "a.dump"), {1: "Si"}, start=1, stop=5, step=2)
    assert sorted((r.frame, r.x) for r in some.collect()) == [(1, 1.0), (3, 3.0)]


def test_distance_of_given_pairs(spark):
    a = spark.createDataFrame([("p", "O", 0.6), ("p", "Si", 0.4), ("q", "Na", 1.0)], "comp_id string, element string, fraction double")
    pairs = spark.createDataFrame([("p", "p"), ("p", "q"), ("q", "none")], "id_a string, id_b string")
    got = {(r.id_a, r.id_b): r.distance for r in K.distance(a, a, pairs).collect()}
    assert got == {("p", "p"): 0.0, ("p", "q"): pytest.approx((0.36 + 0.16 + 1) ** 0.5), ("q", "none"): 1.0}


def test_large_divisors(spark):
    got = series.closest_divisor(spark.createDataFrame([(10_000_000_000, 99_999), (97, 50), (0, 1)], "n long, x long"), "n", "x")
    assert {r.n: r.divisor for r in got.collect()} == {10_000_000_000: 100_000, 97: 1 if 49 < 47 else 97, 0: None}


def test_job_days(spark, tmp_path):
    from vitreon.sources.jobstore import JobStore

    s = JobStore(spark, str(tmp_path / "jobs"))
    s.create(spark.sql("SELECT * FROM VALUES ('a', 'h', 'x', TIMESTAMP '2024-01-02 03:04:05'), ('b', 'h', 'y', TIMESTAMP '2024-01-03 00:00:00') AS t(job_id, request_hash, result_data, created_at)"))
    assert sorted(p.name for p in (tmp_path / "jobs" / "data").glob("*/day=*")) == ["day=2024-01-02", "day=2024-01-03"]
    s.clear_results("h")
    rows = {r.job_id: (r.version, r.result_data) for r in s.jobs().collect()}
    assert rows == {"a": (2, None), "b": (2, None)}


def test_submission(spark, tmp_path):
    """Normalised, completed, hashed; hit once a job is done, whatever the order and scale of amounts; faults by kind."""
    from vitreon.sources.jobstore import JobStore

    rows = [("a", 0, "SiO2", 80.0), ("a", 1, "Na2O", 20.0), ("b", 0, "Na2O", 0.2), ("b", 1, "SiO2", 0.8), ("c", 0, "SiO2", 50.0), ("c", 1, "Na2O", 10.0), ("d", 0, "SiO2", 70.0), ("d", 1, "Xx2O", 30.0), ("e", 0, "SiO2", 99.0), ("e", 1, "Na2O", 2.0)]
    comps = spark.createDataFrame(rows, "comp_id string, pos int, oxide string, amount double")
    kind = "comp_id string, potential string, density double, settings map<string,string>, tags array<string>"
    ask = lambda *r: spark.createDataFrame(list(r), kind)
    first = ask(("a", None, None, {"seed": "1", "rate": "2"}, ["x"]), ("c", None, None, None, None), ("d", None, None, None, None), ("e", "shik", 2.5, None, None), ("b", "bjp", None, None, None), ("z", None, None, None, None))
    store = JobStore(spark, str(tmp_path / "jobs"))
    store.create(spark.createDataFrame([], "job_id string"))
    got = {r.comp_id: r for r in store.submit(first, comps, "one").collect()}
    assert got["a"].error is None and got["a"].composition == "Na2O 20 - SiO2 80" and got["a"].potential == "pmmcs" and not got["a"].hit and got["a"].status == "pending"
    assert got["a"].density == pytest.approx(2.391, abs=0.01)
    assert got["c"].error == "composition: sum" and got["d"].error.startswith("composition") and got["z"].error == "composition: missing" and got["b"].error == "potential: unsupported"
    assert got["e"].error is None and got["e"].density == 2.5 and got["e"].potential == "shik" and got["c"].job_id is None
    assert store.jobs().count() == 2
    job = got["a"].job_id
    again = ask(("b", None, None, {"rate": "2", "seed": "1"}, ["y"]))
    assert [r.hit for r in store.submit(again, comps, "two").collect()] == [False]  # not done yet
    store.update(job, status="completed", result_data="{}")
    r = store.submit(again, comps, "three").first()
    assert r.hit and r.job_id == job and r.request_hash == got["a"].request_hash and r.tags == ["x", "y"]
    assert store.get(job).first().tags == ["x", "y"]
    forced = store.submit(again, comps, "four", force=True).first()
    assert not forced.hit and forced.job_id != job


def plain_rings(pairs, most):
    """All shortest paths between the ends of each edge without it, as rings from their smallest node to its smaller neighbour."""
    near = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out = set()
    for u, v in pairs:
        paths = [(u,)]
        seen = {u}
        while paths and len(paths[0]) < most:
            paths = [(*p, y) for p in paths for y in near[p[-1]] if y not in seen and {p[-1], y} != {u, v}]
            seen |= {p[-1] for p in paths}
            if v in seen:
                for p in paths:
                    if p[-1] == v:
                        i = p.index(min(p))
                        turn = p[i:] + p[:i]
                        out.add(min(turn, (turn[0], *reversed(turn[1:]))))
                break
    return out


@pytest.mark.parametrize(("nodes", "n", "most"), [(40, 90, 8), (60, 75, 24), (14, 60, 5), (9, 4, 24)])
def test_rings_equal_the_plain_version(spark, nodes, n, most):
    rng = np.random.default_rng(nodes)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, nodes, (n, 2)) if p[0] != p[1]}
    e = spark.createDataFrame([(s, 0, u, v) for s in ("a", "b") for u, v in pairs], "structure_id string, frame int, u long, v long")
    want = plain_rings(pairs, most)
    got = graph.rings(e, most).collect()
    assert len(got) == 2 * len(want)
    for s in ("a", "b"):
        assert {tuple(r.ring) for r in got if r.structure_id == s and r["size"] == len(r.ring)} == want


def test_multiple_tau():
    """Level 0 is the autocorrelation; higher levels are that of means; a state taken out and put back goes on alike."""
    from vitreon.streaming.correlator import MultipleTau

    x = np.random.default_rng(1).normal(size=(200, 2)).cumsum(axis=0)
    whole, tau = MultipleTau(2, 8, 4), MultipleTau(2, 8, 4)
    for i, v in enumerate(x):
        whole.add(v)
        if i % 37 == 0:
            tau = MultipleTau.of(2, 8, 4, tau.state())
        tau.add(v)
    lag, c = tau.curve()
    assert lag.tolist() == [*range(8), 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56] and np.array_equal(c, whole.curve()[1])
    for k in range(8):
        assert c[k] == pytest.approx((x[: 200 - k] * x[k:]).mean(axis=0))
    b = x.reshape(50, 4, 2).mean(axis=1)
    assert c[lag.tolist().index(20)] == pytest.approx((b[:-5] * b[5:]).mean(axis=0))


def test_lifecycles(spark, tmp_path):
    """No way back from an end, silence times out, late events are ignored, and ended jobs are forgotten."""
    from datetime import datetime, timedelta

    from vitreon.streaming import jobs as streams
    from vitreon.streaming import lifecycle

    lifecycle.use_rocksdb(spark)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    events = [
        [("a", at(0), 1, "pending"), ("a", at(1), 2, "running"), ("b", at(0), 3, "running"), ("c", at(0), 4, "running"), ("d", at(0), 5, "completed")],
        [("a", at(2), 6, "completed"), ("c", at(2.5), 7, "failed"), ("x", at(20), 8, "pending")],
        [("a", at(19.5), 9, "running"), ("b", at(19.6), 10, "completed"), ("c", at(19.7), 11, "running"), ("d", at(19.8), 12, "running"), ("x", at(60), 13, "running")],
    ]
    parts = [spark.createDataFrame(rows, "job_id string, ts timestamp, event_id long, status string") for rows in events]
    got = streams.in_turn(parts, lambda e: lifecycle.lifecycles(e, "10 hours", "17 hours"), str(tmp_path), "update").collect()
    last = {}
    for r in sorted(got, key=lambda r: (r.batch, r.ended_us is not None, r.ended_us or 0)):
        last[r.job_id] = r.status
    # d, ended at hour 0, is forgotten when the watermark passes hour 17; its later event begins a new life, which times out
    assert last == {"a": "completed", "b": "timed_out", "c": "failed", "d": "timed_out", "x": "timed_out"}
    assert [r.status for r in got if r.job_id == "a"][-1] == "completed"


def test_moments_merge(spark, tmp_path):
    """Increments written in any number, and written again, give the moments of all rows."""
    from vitreon.operators import moments

    rng = np.random.default_rng(4)
    rows = [(i % 3 if i % 3 else None, float(1e6 + x), float(x * 2 + y), i % 4) for i, (x, y) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 0)], "g int, a double, b double, k int")
    store = moments.Increments(spark, str(tmp_path), ["g"], ["a", "b"])
    for k in (0, 1, 2, 3, 1):
        store.add(str(k), df.where(f"k = {k}"))
    got = {r.g: r for r in store.now().collect()}
    for g in (None, 1, 2):
        x = np.array([r[1:3] for r in rows if r[0] == g])
        c = np.cov(x.T, bias=True) * len(x)
        assert got[g].n == len(x) and got[g].mean_a == pytest.approx(x[:, 0].mean()) and got[g].m_a_b == pytest.approx(c[0, 1], rel=1e-6) and got[g].m_a_a == pytest.approx(c[0, 0], rel=1e-6)


def test_all_values_settle(spark, tmp_path):
    """A run goes on until every value's error is small, over several batches, and then ignores what follows."""
    from vitreon.streaming import jobs as streams

    rng = np.random.default_rng(17)
    rows = [(r, i, 10 + 0.1 * rng.normal(), 5 + (3.0 if r == "b" else 0.2) * rng.normal()) for i in range(30) for r in ("a", "b")]
    schema = "run_id string, step int, v double, l double"
    path = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame([x for x in rows if x[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drained(streams.settle_all(stream, ["v", "l"], 0.08, 3, 25, ["step"]), str(tmp_path / "out"), "update").collect()
    for run in ("a", "b"):
        x = np.array([r[2:] for r in rows if r[0] == run])
        stop = next((n for n in range(1, 31) if n >= 25 or n >= 3 and (x[:n].std(0, ddof=1) / n**0.5).max() < 0.08), 30)
        last = max((r for r in got if r.run_id == run), key=lambda r: r.batch)
        assert last.n == stop and last.done and list(last.mean) == pytest.approx(list(x[:stop].mean(0)))
        assert list(last.sem) == pytest.approx(list(x[:stop].std(0, ddof=1) / stop**0.5))


def test_two_writers_lose_nothing(spark, tmp_path):
    """Writers that meet try again: every update gets a version of its own, a cancelled job stays so, reads stay short."""
    from concurrent.futures import ThreadPoolExecutor

    from vitreon.sources.jobstore import JobStore

    store = JobStore(spark, str(tmp_path / "jobs"), snapshot_after=4)
    store.create(spark.createDataFrame([("a", "running"), ("b", "pending")], "job_id string, status string"))
    with pytest.raises(ValueError):
        store.create(spark.createDataFrame([("a", "running")], "job_id string, status string"))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: JobStore(spark, str(tmp_path / "jobs"), snapshot_after=4).update("a", request_data=str(k)), range(8)))
    assert store.get("a").first().version == 9
    assert len(store._tail()[1]) <= 6 and len(store.commits()) > 9  # a snapshot and a few commits
    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(lambda f: f(), [lambda: store.cancel("b"), lambda: store.cancel("b")]))
    assert sorted(done) == [False, True] and store.get("b").first().version == 2
    assert not store.update("nobody", status="failed")
    n = store.commits()[-1]
    assert not store._put(n, {}) and store.jobs().count() == 2


def test_dump_reads_only_its_frames(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    from vitreon.sources import dumps

    text = "".join(f"ITEM: TIMESTEP\n{k * 10}\nITEM: NUMBER OF ATOMS\n50\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type x y z\n" + "".join(f"{i} 1 {k}.5 {i % 10} 1\n" for i in range(1, 51)) for k in range(40))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dump").write_text(text)
    dumps.write_index(spark, str(tmp_path / "in"), str(tmp_path / "index"), reach=777)  # ranges that cut headers
    index = spark.read.parquet(str(tmp_path / "index")).orderBy("frame").collect()
    assert [r.frame for r in index] == list(range(40)) and sum(r.length for r in index) == len(text)
    read = []
    monkeypatch.setattr(dumps, "_read", lambda p, start, n, f=dumps._read: read.append(n) or f(p, start, n))
    one = dumps.DumpReader({"index": str(tmp_path / "index"), "types": "1=Si"})
    rest = list(one.pushFilters([EqualTo(("frame",), 7), GreaterThan(("x",), 1.0), IsNotNull(("frame",))]))
    rows = [r for p in one.partitions() for r in one.read(p)]
    assert len(rows) == 50 and sum(read) == index[7].length < len(text) / 30 and len(rest) == 2
    df = dumps.read_frames(spark, str(tmp_path / "index"), {1: "Si"})
    assert {(r.frame, r.step, r.n, r.x) for r in df.where("frame >= 38 and x > 0").groupBy("frame", "step").agg(F.count("*").alias("n"), F.max("x").alias("x")).collect()} == {(38, 380, 50, 38.5), (39, 390, 50, 39.5)}


def test_files_are_written_all_or_none(spark, tmp_path):
    from vitreon.sources import dumps

    rows = spark.range(6).select(F.concat(F.lit("f"), "id").alias("file"), F.concat(F.lit("text "), "id").alias("text")).repartition(3, "file")
    bad = rows.withColumn("text", F.when(F.col("file") == "f4", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    path = tmp_path / "out"
    for df in (bad, rows.unionByName(rows.limit(1))):
        with pytest.raises(Exception):
            dumps.write_files(df, str(path))
        assert not [f for f in path.rglob("*") if f.is_file()]
    dumps.write_files(rows, str(path))
    assert {f.name: f.read_text() for f in path.iterdir()} == {f"f{i}": f"text {i}" for i in range(6)}
    with pytest.raises(Exception):
        dumps.write_files(rows.limit(1), str(path), overwrite=False)


@pytest.mark.parametrize("block", [7, 64])
def test_long_runs(spark, block):
    """Blocks of any size give what one pass over a run gives, for runs of many lengths, repeated times and a null run."""
    from vitreon.operators import longruns as LR
    from vitreon.operators import series as S

    rng = np.random.default_rng(block)
    rows = [(g, int(rng.integers(0, 50)), k, float(x)) for g, n in (("a", 150), ("b", 1), ("c", 7), (None, 20), ("d", 65)) for k, x in enumerate(rng.normal(3, 1, n))]
    df = spark.createDataFrame(rows, "run string, t int, k int, y double")
    p = LR.placed(df.repartition(5), ["run"], ["t", "k"]).cache()
    for g in ("a", "b", "c", None, "d"):
        y = np.array([r[3] for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3])])
        of = lambda d, g=g: [tuple(r) for r in d.where(F.col("run").eqNullSafe(F.lit(g))).orderBy(d.columns[1]).collect()]
        assert [r[1:] for r in of(p.select("run", "_pos", "y"))] == list(enumerate(y.tolist()))
        n = len(y)
        got = of(LR.running_mean(p, ["run"], "y", 5, "m", block).select("run", "_pos", "m"))
        assert [r[2] for r in got] == [pytest.approx(y[i - 2 : i + 3].mean()) if 2 <= i < n - 2 else None for i in range(n)]
        got = of(LR.cumulative_trapezoid(p, ["run"], "y", F.lit(0.5), "i", block).select("run", "_pos", "i"))
        assert [r[2] for r in got] == pytest.approx([0.0, *np.cumsum((y[1:] + y[:-1]) / 4)])
        got = of(LR.cumulative_sem(p, ["run"], "y", block).select("run", "_pos", "mean", "sem"))
        assert [r[2] for r in got] == pytest.approx([y[: i + 1].mean() for i in range(n)])
        assert [r[3] for r in got] == pytest.approx([y[: i + 1].std(ddof=1) / (i + 1) ** 0.5 if i else 0.0 for i in range(n)], abs=1e-9)
        for most in (None, 10):
            got = of(LR.acf(p, ["run"], "y", most, block))
            assert [r[1] for r in got] == list(range(min(n, most or n))) and [r[2] for r in got] == pytest.approx(S.autocorrelation(y, most or n).tolist())
    p.unpersist()
    with pytest.raises(ValueError):
        LR.running_mean(p, ["run"], "y", 2 * block + 3, "m", block)


def test_pair_table(spark):
    """The table of a pair: even in r squared, the force minus the derivative of the energy."""
    from vitreon.operators import potentials as P

    t = P.pair_table(spark, ("Si", "O"), n=4001).orderBy("i").toPandas()
    assert t["r"].iloc[0] == pytest.approx(0.1) and t["r"].iloc[-1] == pytest.approx(10.5) and np.diff(t["r"] ** 2) == pytest.approx((10.5**2 - 0.01) / 4000)
    far = t[t["r"] > 1.5]
    slope = np.gradient(far["energy"].to_numpy(), far["r"].to_numpy())
    assert far["force"].to_numpy()[5:-5] == pytest.approx(-slope[5:-5], rel=5e-3, abs=2e-3)


@pytest.mark.parametrize(("pivots", "rings"), [(1, 3), (5, 4), (64, 64)])
def test_nearest_is_exact(spark, pivots, rings):
    """Repeated rows and ties, one crowded place, vectors that are missing or too short, fewer rows than asked for."""
    from vitreon.operators import nearest

    rng = np.random.default_rng(pivots)
    x = np.vstack([rng.normal(size=(60, 3)), np.repeat([[9.0, 9.0, 9.0]], 40, axis=0), rng.normal(size=(20, 3)) * 0.01 + 5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (901, [1.0])], "id long, vector array<double>")
    q = df.where("id % 7 = 0 or id >= 900").withColumnRenamed("id", "query_id")
    for k in (3, 500):
        got = nearest.nearest(q, df, k, pivots, rings).collect()
        for i, v in rows[::7]:
            d = sorted((float(np.sqrt(((x[j] - v) ** 2).sum())), j) for j in range(len(x)) if j != i)[:k]
            mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
            assert [r.id for r in mine] == [j for _, j in d] and [r.distance for r in mine] == pytest.approx([e for e, _ in d])
        assert {r.query_id for r in got} == set(range(0, len(x), 7))
    if pivots > 1:
        assert sum(r.compared for r in nearest.nearest(q, df, 3, pivots, rings).where("rank = 1").collect()) < len(rows[::7]) * len(x) * 0.8
    assert nearest.nearest(q, df.limit(0), 3).collect() == []


def test_bonds_longer_than_four(spark):
    """A cutoff counts as it is, however long."""
    from vitreon.plans import analyze

    a = spark.createDataFrame([("s", 0, 1, 8, 0.0, 0.0, 0.0), ("s", 0, 2, 56, 4.6, 0.0, 0.0), ("s", 0, 3, 56, 0.0, 5.5, 0.0)], "structure_id string, frame int, atom_id long, atomic_number int, x double, y double, z double")
    f = spark.createDataFrame([("s", 0, *(20.0 if i == j else 0.0 for i in range(3) for j in range(3)))], "structure_id string, frame int, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3)))
    lim = spark.createDataFrame([("s", 0, 56, 5.0)], "structure_id string, frame int, atomic_number int, cutoff double")
    assert sorted((r.i, r.j) for r in analyze.bonds(a, f, lim).collect()) == [(1, 2), (2, 1)]


def test_documents(spark):
    from vitreon.operators import jobs as J

    texts = ['{"analyses":[{"type":"cte","n":1},{"n":2},{"type":"cte","n":3},7],"structure":{"numbers":[8,14]}}', '{"structure":"{\\"numbers\\":[1,2]}"}', '{"structure":"not json","analyses":"x"}', "{", "[]", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = J.documents(df, "t").orderBy("k").select("analyses", "numbers", J.first_parameter(F.col("v"), "cte", "n", "int").alias("n"), F.col("v").isNull().alias("broken")).collect()
    assert [r.analyses for r in got] == [["cte", "cte"], [], [], [], [], [], []]
    assert [r.numbers for r in got] == [[8, 14], [1, 2], None, None, None, None, None]
    assert [r.n for r in got] == [1, *[None] * 6] and [r.broken for r in got][3] and got[6].broken


@pytest.mark.parametrize("n", [40, 400])
def test_crowded_rings_are_counted_by_bits(spark, monkeypatch, n):
    """Triangles of a crowded structure are not listed; a ring of seven hangs on it, and a sparse structure beside it is searched as before."""
    rng = np.random.default_rng(n)
    dense = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.5 if n < 100 else 0.97)]
    tail = [(0, n), *((n + k, n + k + 1) for k in range(5)), (1, n + 5), (n + 2, n + 90)]
    sparse = [(i, (i + 1) % 9) for i in range(9)] + [(0, 2)]
    rows = [("d", 0, *e) for e in (*dense, *tail)] + [("s", 1, *e) for e in sparse]
    monkeypatch.setattr(graph, "TILE", 16 if n < 100 else 128)
    edges = spark.createDataFrame(rows, "structure_id string, frame int, u long, v long")
    m = np.zeros((n + 91, n + 91))
    for u, v in (*dense, *tail):
        m[u, v] = m[v, u] = 1
    triangles = int(np.trace(m @ m @ m)) // 6
    sizes = {(r.structure_id, r["size"]): r.n for r in graph.ring_sizes(edges).collect()}
    assert sizes["d", 3] == triangles and sizes["s", 3] == 1 and sizes["s", 8] == 1
    assert {(r.structure_id, r.n) for r in graph.triangle_numbers(edges).collect()} == {("d", triangles), ("s", 1)}
    common = {(u, v): int((m @ m)[u, v]) for u, v in dense} if n < 100 else {}
    got = graph.ring_counts(edges).collect()
    for (u, v), c in common.items():
        assert c == 0 or any((r.structure_id, r.u, r.v, r["size"], r.n) == ("d", u, v, 3, c) for r in got)
    by = {}
    for r in got:
        e, p = by.get((r.structure_id, r["size"]), (0, 0))
        by[r.structure_id, r["size"]] = e + 1, p + r.n
    assert by == {(r.structure_id, r["size"]): (r.edges, r.paths) for r in graph.ring_totals(edges).collect()}
    if n < 100:
        assert sizes == {(r.structure_id, r["size"]): r.n for r in graph.ring_histogram(graph.rings(edges)).collect()}


def test_crowded_former_edges(spark, monkeypatch):
    """Formers that share many oxygens, in tiles, and a structure with few."""
    monkeypatch.setattr(graph, "TILE", 16)
    rng = np.random.default_rng(3)
    shared = {("d", o, f) for o in range(1000, 1060) for f in range(50) if rng.random() < 0.2} | {("s", 1, 2), ("s", 1, 3), ("s", 2, 3), ("s", 2, 4)}
    found = spark.createDataFrame([(s, 0, o, f, 8, 14) for s, o, f in shared], "structure_id string, frame int, i long, j long, zi int, zj int")
    want = {(s, f, g) for s, o, f in shared for t, p, g in shared if s == t and o == p and f < g}
    got = [(r.structure_id, r.u, r.v) for r in graph.former_edges(found, [14]).collect()]
    assert len(got) == len(want) and set(got) == want


def test_crowded_rings_from_former_edges(spark, monkeypatch):
    """The rows of bits of crowded structures give the rings that their edges give."""
    monkeypatch.setattr(graph, "TILE", 16)
    rng = np.random.default_rng(5)
    shared = {("d", o, f) for o in range(1000, 1060) for f in range(50) if rng.random() < 0.2} | {("s", 1, 2), ("s", 1, 3), ("s", 2, 3), ("s", 2, 4), ("s", 3, 4), ("s", 3, 2)}
    found = spark.createDataFrame([(s, 0, o, f, 8, 14) for s, o, f in shared], "structure_id string, frame int, i long, j long, zi int, zj int")
    edges = graph.former_edges(found, [14])
    pairs = {(r.u, r.v) for r in edges.collect() if r.structure_id == "d"}
    m = np.zeros((50, 50))
    for u, v in pairs:
        m[u, v] = m[v, u] = 1
    got = {(r.structure_id, r["size"]): r.n for r in graph.ring_sizes(edges).collect()}
    assert len(pairs) > 16 * 50 / 2 and got["d", 3] == int(np.trace(m @ m @ m)) // 6 and got["s", 3] == 1


def test_blocks_grow_with_the_run():
    assert [longruns.block_for(n, 1024) for n in (10, 32768, 100_000, 6_000_000)] == [1024, 1024, 4096, 262144]
    assert longruns.block_for(10**9) == 1 << 20


def test_angles_of_crowded_structures(spark):
    """Counted in blocks, they are those that the join lists: at limits of bins, for few and for many neighbours, in one grid cell and in many."""
    import math

    from vitreon.operators import angles as A
    from vitreon.operators import neighbors, structure

    rng = np.random.default_rng(5)
    axes = np.vstack([np.eye(3), -np.eye(3), [[1, 1, 0], [0, 1, 1], [-1, 1, 0]]])  # 45, 90, 180 degrees, on limits
    u = np.vstack([axes / np.linalg.norm(axes, axis=1)[:, None], (v := rng.normal(size=(300, 3))) / np.linalg.norm(v, axis=1)[:, None]])
    count = A.Counter(36)
    count.add(u)
    i, j = np.triu_indices(len(u), 1)
    dots = u[i, 0] * u[j, 0] + u[i, 1] * u[j, 1] + u[i, 2] * u[j, 2]
    want = np.bincount([min(math.floor(math.degrees(math.acos(max(-1.0, min(1.0, c)))) / 5.0), 35) for c in dots], minlength=36)
    assert (count.total() == want).all()
    rows = [("a", 0, k, 14 if k % 5 == 0 else 8, *(float(x) for x in p)) for k, p in enumerate(rng.uniform(0, 9, (900, 3)))]
    rows += [("b", 0, k, 14 if k % 3 == 0 else 8, *(float(x) for x in p)) for k, p in enumerate(rng.uniform(0, 20, (150, 3)))]
    a = spark.createDataFrame(rows, "structure_id string, frame int, atom_id long, atomic_number int, x double, y double, z double")
    f = spark.createDataFrame([("a", 0, 9.0, 0.0, 0.0, 2.0, 9.0, 0.0, 0.0, 1.0, 9.0), ("b", 0, 20.0, 0.0, 0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 20.0)], "structure_id string, frame int, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3)))
    assert [r.structure_id for r in A.crowded(a, f, 3.0, 8).collect()] == ["a"]
    both = [sorted(map(tuple, df.collect())) for df in (structure.angles(neighbors.pairs(a, f, 3.0), 14, 8, 36), A.angles_within(a, f, 3.0, 14, 8, 36))]
    assert both[0] == both[1] and {r[0] for r in both[0]} == {"a", "b"}


def test_nearest_in_blocks(spark, monkeypatch):
    """Several blocks of queries and of rows: the same rows, and only the nearest of a pair of blocks go on."""
    from vitreon.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(150, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = nearest.nearest(df.where("id % 3 = 0").withColumnRenamed("id", "query_id"), df, 4, pivots=3).collect()
    for i in range(0, 150, 3):
        d = sorted((float(np.sqrt(np.add.accumulate((x[i] - x[j]) ** 2)[-1])), j) for j in range(150) if j != i)[:4]
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [(r.distance, r.id) for r in mine] == d and all(4 <= r.compared <= 149 for r in mine)


def test_totals_of_units_are_not_listed(spark):
    """The plan of to_atoms makes no row for a total that competes, and equal remainders go by pos."""
    import contextlib
    import io

    from vitreon.operators import composition as K

    c = spark.createDataFrame([("a", 0, "SiO2", 0.5), ("a", 1, "Na2O", 0.25), ("a", 2, "CaO", 0.25), ("b", 0, "SiO2", 1.0)], "comp_id string, pos int, oxide string, fraction double")
    df = K.to_atoms(c, 100, 40)
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    assert "sequence" not in text.getvalue()
    got = {(r.comp_id, r.oxide): (r.units, r.n_units, r.n_atoms) for r in df.collect()}
    assert got == {("a", "SiO2"): (18, 36, 99), ("a", "Na2O"): (9, 36, 99), ("a", "CaO"): (9, 36, 99), ("b", "SiO2"): (33, 33, 99)}


def test_viscosity_reads_runs_in_turn(spark):
    """Many runs of a task, some across the batches that it gets, are those that each would be alone; no group is made of each."""
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", k, 3000.0, 8000.0, *rng.normal(size=3).tolist()) for i in range(9) for k in range(60 + i)]
    th = spark.createDataFrame(rows, "run_id string, step long, temperature double, volume double, pxy double, pxz double, pyz double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = series.viscosity(th, 1000.0, "helfand")
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
        got = {r.run_id: r.viscosity for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i in range(9):
        p = np.array([r[4:] for r in rows if r[0] == f"r{i}"])
        assert got[f"r{i}"] == pytest.approx(series.helfand(p, 1000.0, 8000.0, 3000.0)["viscosity"])


def test_ring_search_writes_a_table_a_layer(spark, monkeypatch):
    """A ring of nine is found at length 8; each length writes one table, and the analysis keeps no plan of another part in its own."""
    from vitreon import scratch
    from vitreon.plans import analyze

    edges = spark.createDataFrame([("s", 0, k, (k + 1) % 9) for k in range(9)], "structure_id string, frame int, u long, v long")
    own, near, _, _ = graph._split(edges)
    keep, kept = scratch.Stored.keep, []
    monkeypatch.setattr(scratch.Stored, "keep", lambda self, df: kept.append(1) or keep(self, df))
    met, layers, _ = graph._met(own, 24, near)
    assert {(r.u, r.v, r.size, int(r.n)) for r in met.collect()} == {(min(k, (k + 1) % 9), max(k, (k + 1) % 9), 9, 1) for k in range(9)}
    assert layers.count() == 9 * 10  # the ends, and four layers of one node on each side; the ninth node is reached twice
    assert len(kept) <= 2 + 8
    a, f = make(spark, [(14, (4, 4, 10)), (8, (5.6, 4, 10))], cube(20))
    out = analyze.analyze(a, f, 9.0, 20, n_q=3)
    assert "InMemory" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.first().n_atoms == 2


def _calls(monkeypatch):
    """How often state was read, while the processors below run here on a store of their own."""
    class Value:
        def __init__(self):
            self.v, self.reads, self.writes = None, 0, 0

        def get(self):
            self.reads += 1
            return self.v

        def exists(self):
            self.reads += 1
            return self.v is not None

        def update(self, v):
            self.v, self.writes = v, self.writes + 1

        def clear(self):
            self.v = None

    class Handle:
        def __init__(self):
            self.value, self.timers = Value(), set()

        def getValueState(self, *_):  # noqa: N802
            return self.value

        def listTimers(self):  # noqa: N802
            return iter(sorted(self.timers))

        def registerTimer(self, t):  # noqa: N802
            self.timers.add(t)

        def deleteTimer(self, t):  # noqa: N802
            self.timers.discard(t)

    return Handle()


def test_lifecycles_share_state_in_buckets(monkeypatch):
    """A hundred jobs of a bucket cost one read and one write of state a batch, and one timer serves all that are due."""
    from types import SimpleNamespace as N

    from vitreon.streaming.lifecycle import Lifecycle

    h = _calls(monkeypatch)
    one = Lifecycle(10_000, 50_000)
    one.init(h)
    rows = [N(job_id=f"j{i}", at_us=i * 100, event_id=i, status="completed" if i % 10 == 0 else "running") for i in range(100)]
    got = list(one.handleInputRows((7,), iter(rows), None))
    assert len(got) == 100 and h.value.reads == h.value.writes == 1 and h.timers == {11}
    assert {r.job_id for r in got if r.ended_us is not None} == {f"j{i}" for i in range(0, 100, 10)}
    h.timers.discard(11)
    # of the running jobs those time out that are due before the watermark; the next timer is for the first that is left
    out = list(one.handleExpiredTimer((7,), N(getCurrentWatermarkInMs=lambda: 15), N(getExpiryTimeInMs=lambda: 11)))
    assert {r.job_id for r in out} == {f"j{i}" for i in range(40) if i % 10} and all(r.status == "timed_out" for r in out) and h.timers == {15}
    late = list(one.handleInputRows((7,), iter([N(job_id="j1", at_us=20_000, event_id=200, status="running"), N(job_id="j50", at_us=90_000, event_id=201, status="failed")]), None))
    assert {(r.job_id, r.status) for r in late} == {("j1", "timed_out"), ("j50", "completed")}
    # all are forgotten in the end
    for at in (10**6, 2 * 10**6):
        list(one.handleExpiredTimer((7,), N(getCurrentWatermarkInMs=lambda: at), N(getExpiryTimeInMs=lambda: at)))
    assert h.value.v is None


def test_viscosities_share_state_in_buckets(monkeypatch):
    """Many runs of a bucket, over two batches, each as the correlator of its own has it; state is read and written once a batch."""
    import pandas as pd

    from vitreon.streaming.correlator import MultipleTau, _Viscosity

    h, rng = _calls(monkeypatch), np.random.default_rng(3)
    one = _Viscosity(["a", "b"], ["step"], 2.0, 4, 3, 8, 0.3, 1)
    one.init(h)
    runs = {f"r{i}": rng.normal(size=(5 + 3 * i, 2)).cumsum(axis=0) for i in range(30)}
    df = pd.DataFrame([(r, i, *v) for r, x in runs.items() for i, v in enumerate(x)], columns=["run_id", "step", "a", "b"])
    parts = [df[df["step"] < 20].sample(frac=1, random_state=1), df[df["step"] >= 20]]
    last = {}
    for p in parts:
        for got in one.handleInputRows((0,), iter([p.iloc[:50], p.iloc[50:]]), None):
            last |= {r.run_id: r for r in got.itertuples()}
    assert h.value.reads == h.value.writes == 2
    for r, x in runs.items():
        tau, before, done = MultipleTau(2, 4, 3), None, False
        for v in x:
            if done:
                break
            tau.add(v)
            if tau.n % 8 == 0:
                eta = tau.integral() * 2.0
                before, done = eta, before is not None and abs(eta - before) < 0.3 * abs(eta)
        assert (last[r].n, bool(last[r].done)) == (tau.n, done) and last[r].viscosity == pytest.approx(tau.integral() * 2.0)
    assert 0 < sum(bool(r.done) for r in last.values()) < 30


def _crowd_of(seed, n=120):
    """Formers and oxygens of a crowded structure in a sheared cell and of one in a cube, some oxygens in a third."""
    rng = np.random.default_rng(seed)
    cells = {"t": np.array([[8.0, 0, 0], [2, 7, 0], [1, 1, 9]]), "c": np.diag([8.0, 8, 8]), "s": np.diag([40.0, 40, 40])}
    f = {s: rng.random((n, 3)) for s in cells}
    z = [14 if k % 3 else 8 for k in range(n)]
    atoms = [(s, 0, k, z[k], *(f[s][k] @ c).tolist()) for s, c in cells.items() for k in range(n)]
    frames = [(s, 0, *c.ravel().tolist()) for s, c in cells.items()]
    want = {}
    for s, c in cells.items():
        g = f[s][None] - f[s][:, None]
        d = (g - np.rint(g)) @ c
        want[s] = np.sqrt((d * d).sum(axis=2))
    return atoms, frames, np.array(z), want


@pytest.mark.parametrize("cutoff", [1.2, 2.6])
def test_edges_of_crowded_structures_without_their_pairs(spark, monkeypatch, cutoff):
    """Blocks of formers meet the oxygens in a task: no pair of a crowded structure is a row, and the edges are the same."""
    from vitreon.operators import contacts

    for name, v in {"SIDE": 32, "STRIP": 8, "_FIRST": 5, "_STEP": 7, "_MANY": 0.3, "_FULL": 600}.items():
        monkeypatch.setattr(contacts, name, v)
    atoms, frames, z, far = _crowd_of(7)
    a = spark.createDataFrame(atoms, "structure_id string, frame int, atom_id long, atomic_number int, x double, y double, z double")
    f = spark.createDataFrame(frames, "structure_id string, frame int, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3)))
    found, dense = graph.apart(a, f, cutoff, [14])
    assert {r.structure_id for r in found.select("structure_id").distinct().collect()} <= {"s"}
    edges = graph.former_edges(found, [14], 8, dense)
    near = {s: (d[z == 8] <= cutoff).astype(int) for s, d in far.items()}
    want = {(s, int(u), int(v)) for s, m in near.items() for u, v in np.argwhere(np.triu(m.T @ m, 1)) if z[u] == z[v] == 14}
    got = [(r.structure_id, r.u, r.v) for r in edges.collect()]
    assert len(got) == len(want) and set(got) == want and {"t", "c"} <= {w[0] for w in want}
    plain = graph.former_edges(neighbors.pairs(a, f, cutoff), [14])
    assert {tuple(r) for r in graph.ring_sizes(edges, 5).collect()} == {tuple(r) for r in graph.ring_sizes(plain, 5).collect()}


def test_triangles_of_nearly_whole_structures(spark, monkeypatch):
    """The pairs that a structure lacks give its triangles; rows of bits are multiplied for no structure that lacks few."""
    from vitreon.operators import contacts

    for name, v in {"SIDE": 32, "STRIP": 8, "_MANY": 0.3, "_FULL": 600}.items():
        monkeypatch.setattr(contacts, name, v)
    monkeypatch.setattr(graph, "_WHOLE", 5)
    atoms, frames, z, far = _crowd_of(9)
    a = spark.createDataFrame(atoms, "structure_id string, frame int, atom_id long, atomic_number int, x double, y double, z double").where("structure_id <> 's'")
    f = spark.createDataFrame(frames, "structure_id string, frame int, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3))).where("structure_id <> 's'")
    found, dense = graph.apart(a, f, 3.4, [14])
    edges = graph.former_edges(found, [14], 8, dense)
    want, lacks = {}, 0
    for s in "tc":
        near = (far[s][np.ix_(z == 8, z == 14)] <= 3.4).astype(int)
        m = (near.T @ near > 0) & ~np.eye(near.shape[1], dtype=bool)
        want[s], lacks = int(np.trace(np.linalg.matrix_power(m.astype(np.int64), 3))) // 6, lacks + (~m).sum() - len(m)
    counted, rest = graph._by_gaps(edges)
    assert lacks and {r.structure_id: r.n for r in counted.collect()} == want and rest.crowd[0].isEmpty()
    assert {r.structure_id: r.n for r in graph.triangle_numbers(edges).collect()} == want


def test_analysis_of_crowded_structures_lists_no_pairs(spark, monkeypatch):
    """Coordination, oxygen classes, Qn and angles of crowded structures are those of the distances, with no pair of an atom and an oxygen listed."""
    from vitreon.operators import contacts
    from vitreon.plans import analyze

    for name, v in {"SIDE": 32, "STRIP": 8, "_MANY": 0.3, "_FULL": 10**6}.items():
        monkeypatch.setattr(contacts, name, v)
    bonds, listed = analyze.bonds, []
    monkeypatch.setattr(analyze, "bonds", lambda *a: listed.append(bonds(*a)) or listed[-1])
    atoms, frames, z, far = _crowd_of(11)
    a = spark.createDataFrame(atoms, "structure_id string, frame int, atom_id long, atomic_number int, x double, y double, z double").where("structure_id <> 's'")
    f = spark.createDataFrame(frames, "structure_id string, frame int, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3))).where("structure_id <> 's'")
    got = analyze.analyze(a, f, 4.0, 40, 12, 4, n_q=3).select("structure_id", "cutoffs", "coordination", "oxygen", "qn", "angles").collect()
    assert len(listed) == 1 and listed[0].isEmpty() and {r.structure_id for r in got} == {"t", "c"}
    tally = lambda x: {str(k): n for k, n in zip(*(v.tolist() for v in np.unique(x, return_counts=True)), strict=True)}
    for r in got:
        near = far[r.structure_id][np.ix_(z == 14, z == 8)] <= r.cutoffs["Si"]
        cn, k = near.sum(axis=1), near.sum(axis=0)
        assert r.coordination["Si"] == tally(cn) and len(r.coordination["Si"]) > 1
        assert r.oxygen == tally(np.array(["free", "NBO", "BO", "tri"])[np.minimum(k, 3)])
        assert {n: c for n, c in r.qn.items() if c} == tally(near[:, k >= 2].sum(axis=1))
        assert sum(r.angles.values()) == (cn * (cn - 1) // 2).sum()
