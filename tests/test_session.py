"""Expressions, sources and saved results over a project of known curves."""

import os
import sqlite3

import numpy as np
import pandas as pd
import pytest

from curvelake.errors import FieldError
from curvelake.plans import tree
from curvelake.session import Session
from curvelake.shell import Shell
from curvelake.sources import readers
from curvelake.sources.tables import Table


def test_align_drops_the_unmatched_key(session):
    got = session.eval("dE").to_pandas()
    assert len(got) == 3 * 200
    assert np.nanmax(abs(got["value"])) < 1e-2  # both are the same curve, sampled apart


def test_same_points_need_no_grid(session):
    got = session.eval("a.E - a.E + a.T").to_pandas()
    assert len(got) == 160 and np.allclose(got["value"], got["T"])


def test_broadcast_and_pruning(session):
    got = session.eval("a.E + g.gap", where="U=2").to_pandas()
    assert len(got) == 80 and np.allclose(got["value"], got["T"] ** 2)
    assert session.tables["a"].read_paths == ["U_2/n_0.5.dat", "U_2/n_1.0.dat"]


def test_calculus(session):
    d = session.eval("d(a.E, T, method=cubic)").to_pandas()
    assert np.allclose(d["value"], 2 * d["T"], atol=1e-6)
    i = session.eval("integral(a.E + g.gap, T, method=pchip)").to_pandas()
    assert np.allclose(i["value"], (1 - 0.05**3) / 3, atol=5e-3)
    leg = session.eval("legendre(a.E, T, method=cubic)").to_pandas()
    assert np.allclose(leg["G"], (leg["p"] / 2) ** 2 + leg["U"] * leg["n"], atol=1e-5)


def test_at_swap_and_reductions(session):
    at = session.eval("a.E @ T=0.5").to_pandas()
    assert np.allclose(at["E"], 0.25 - at["U"] * at["n"], atol=1e-2)
    assert len(session.eval("at(a.E, U=1)").to_pandas()) == 80
    sw = session.eval("swap(a.E, T) @ E=-0.75", where="U=2, n=0.5").to_pandas()
    assert np.allclose(sw["T"], 0.5, atol=2e-2)
    m = session.eval("max(a.E) - last(a.E)").to_pandas()
    assert (m["value"] == 0).all()


def test_errors_name_the_cause(session):
    for text, word in (("nope.E", "unknown"), ("a.X", "no input X"), ("a.E[Q=1]", "no column"), ("T + 1", "alone")):
        with pytest.raises(FieldError, match=word):
            session.eval(text)


def test_strict_and_unmatched(session):
    with pytest.raises(FieldError, match="strict"):
        session.eval("a.E - b.E", strict="true")
    with pytest.raises(FieldError, match="without a match"):
        session.eval("a.E - b.E", unmatched="error").to_pandas()


def test_repeats(session, project):
    path = os.path.join(os.path.dirname(project), "data", "a", "U_1", "n_0.5.dat")
    with open(path, "a") as f:
        f.write("1.0 7.0\n")
    s = Session(session.spark, project)
    with pytest.raises(FieldError, match="repeated inputs"):
        s.eval("a.E").to_pandas()
    assert len(s.eval("a.E", duplicates="drop").to_pandas()) == 159
    last = s.eval("last(a.E)", duplicates="last", where="U=1, n=0.5").to_pandas()
    assert last["E"].iloc[0] == 7.0


def test_transform_prunes(session):
    got = session.eval("transform(a.E, U, w=1/U)", where="w=0.5").to_pandas()
    assert set(got["w"]) == {0.5} and session.tables["a"].read_paths == ["U_2/n_0.5.dat", "U_2/n_1.0.dat"]


def test_tree_round_trip(session):
    f = session.field("d(a.E, T) - g.gap")
    node, changed = tree.load(tree.dump(f.node))
    assert node.id == f.node.id and not changed
    assert tree.build(node, session.ctx).df.count() == 160


def test_save_and_refresh_equals_recomputing(session, project):
    session.define("C", "d(a.E, T)")
    session.save("C")
    assert session.status_lines() == ["C: fresh"]
    base = os.path.join(os.path.dirname(project), "data", "a", "U_1")
    with open(os.path.join(base, "n_0.5.dat"), "w") as f:
        f.write("0.1 1\n0.2 3\n0.4 2\n")
    with open(os.path.join(base, "n_2.0.dat"), "w") as f:
        f.write("0.1 5\n0.2 6\n")
    assert session.status_lines() == ["C: stale"]
    assert any("n_2.0.dat" in x for x in session.why("C"))
    assert session.refresh("C") == ["C: recomputed 2 of 5 curves, 3 unchanged"]
    got = session.eval("C").to_pandas()
    want = Session(session.spark, project).eval("d(a.E, T)").to_pandas()
    pd.testing.assert_frame_equal(got.rename(columns={"C": "value"}), want)
    os.remove(os.path.join(base, "n_2.0.dat"))
    assert session.refresh("C")[0].endswith("unchanged") and len(session.eval("C").to_pandas()) == 123
    session.pin("C")
    session.invalidate("C")
    assert session.refresh("C") == ["C: pinned"]
    assert "recomputed all" in session.refresh("C", force=True)[0]


def test_datasets_feed_datasets(session, project):
    session.define("C", "d(a.E, T)")
    session.save("C", fmt="npz")
    session.define("M", "max(C)")
    session.save("M")
    with open(os.path.join(os.path.dirname(project), "data", "a", "U_1", "n_0.5.dat"), "w") as f:
        f.write("0.1 1\n0.2 3\n0.4 2\n")
    assert set(session.status_lines()) == {"C: stale", "M: stale"}
    session.refresh("M")
    assert set(session.status_lines()) == {"C: fresh", "M: fresh"}


def test_registered_data_has_no_recipe(session):
    df = session.eval("a.E").to_pandas()
    session.register("r", df, by=["U", "n"], x="T")
    assert np.allclose(session.eval("r.E - a.E").to_pandas()["value"].dropna(), 0, atol=1e-9)
    session.define("kept", "max(r.E)")
    session.save("kept")
    assert session.status_lines("kept") == ["kept: no recipe"]


def test_handles(session):
    got = ((2 * session.a.E + 1) / session.g.gap - 1).to_pandas()
    assert np.allclose(got["value"], (2 * (got["T"] ** 2 - got["U"] * got["n"]) + 1) / (got["U"] * got["n"]) - 1)


def test_shell(session, tmp_path):
    sh = Shell(session)
    out = sh.run_script("x = max(a.E)  # a comment\nx where U=1 \\\n limit 1\nls\nset method linear\nset\nvalues a.U\nexport a.E where U=1, n=0.5 to out/e.csv\nexport a.E to out/e.dat\nplot a.E by n where U=1 > out/f.gp\ninfo a\nexplain dE\nguess data/a\n")
    text = "\n".join(out)
    assert "variable x" in out and "method = linear" in out and "1.0 2.0" in out and "40 rows in out/e.csv" in out and "U_{U}/n_{n}.dat" in text
    with open(os.path.join(session.folder, "out", "e.dat")) as f:
        assert f.read().count("# U=") == 4
    with pytest.raises(FieldError, match="not fixed"):
        sh.execute("plot a.E where U=1")


def test_sqlite(spark, tmp_path, session):
    con = sqlite3.connect(tmp_path / "wells.db")
    con.execute("CREATE TABLE logs (well TEXT, metres INTEGER, kelvin REAL, sigma REAL)")
    con.executemany("INSERT INTO logs VALUES (?, ?, ?, ?)", [(w, d, 280 + k * d, 0.5 * k) for k, w in ((1, "north"), (2, "south")) for d in (30, 10, 20)])
    con.commit()
    con.close()
    spec = {
        "source": {"locator": "sqlite", "file": "wells.db", "query": "SELECT well, metres / 1000.0 AS depth, kelvin - 273 AS warmth, sigma FROM logs"},
        "field": {"inputs": ["well", "depth"], "outputs": ["warmth"], "axis": "depth"}, "columns": {"warmth": {"error": "sigma"}, "well": {"type": "str"}},
    }
    session.add_table("wells", Table.declared("wells", spec, str(tmp_path)))
    got = session.eval("wells.warmth", where="well=south").to_pandas()
    assert got["depth"].tolist() == [0.01, 0.02, 0.03] and got["warmth"].tolist() == [27.0, 47.0, 67.0]
    assert session.field("wells").type.outs == ["warmth", "sigma"]


def test_binary_and_csv(spark, tmp_path, session):
    """Three columns, one of them left out, in each format; the raw file has blocks of big-endian integers behind a header."""
    x = np.array([[3, 9, 27], [5, 25, 125], [8, 64, 512]])
    for d in ("raw", "npy", "csv", "pq", "one"):
        (tmp_path / d).mkdir()
    (tmp_path / "raw" / "s7.bin").write_bytes(b"\0" * 6 + x.T.astype(">i4").tobytes())
    np.save(tmp_path / "npy" / "s7.npy", x.T.astype(float))
    (tmp_path / "csv" / "s7.csv").write_text("side,area,bulk\n" + "".join(f"{a},{b},{c}\n" for a, b, c in x))
    pd.DataFrame(x, columns=["side", "area", "bulk"]).to_parquet(tmp_path / "pq" / "s7.parquet")
    np.save(tmp_path / "one" / "s7.npy", x[:, 0].astype(float))
    three = ["side", "_", "bulk"]
    forms = {
        "raw": ("bin", {"format": "raw", "columns": three, "header_bytes": 6, "dtype": "int32", "endian": "big", "order": "columns"}),
        "npy": ("npy", {"format": "npy", "columns": three, "transpose": True}),
        "csv": ("csv", {"format": "csv", "rename": {"area": "face"}}), "pq": ("parquet", {"format": "parquet", "rename": {"area": "face"}}),
    }
    for name, (end, reader) in forms.items():
        spec = {"source": {"locator": "glob", "root": name, "pattern": f"s{{shape:int}}.{end}", "reader": reader}, "field": {"inputs": ["shape", "side"], "outputs": ["bulk"], "axis": "side"}}
        session.add_table(name, Table.declared(name, spec, str(tmp_path)))
        got = session.eval(f"{name}.bulk / {name}.side").to_pandas()
        assert got["value"].tolist() == [9.0, 25.0, 64.0] and set(got["shape"]) == {7}, name
    spec = {"source": {"locator": "glob", "root": "one", "pattern": "s{shape:int}.npy", "reader": {"format": "npy", "columns": ["side"]}}, "field": {"inputs": ["shape", "side"]}}
    session.add_table("one", Table.declared("one", spec, str(tmp_path)))
    assert session.eval("one.side").to_pandas()["side"].tolist() == [3.0, 5.0, 8.0]


def test_dataset_fields_are_renamed():
    a = np.array([(1.0, 10), (2.0, 20)], [("t", "f8"), ("n", "i4")])
    spec = {"columns": ["x", "y"]}
    assert readers.dataset_columns(a, spec | {"fields": {"time": "t"}}) == {"time": [1.0, 2.0]}
    assert readers.dataset_columns(a, spec) == {"t": [1.0, 2.0], "n": [10, 20]}
    assert readers.dataset_columns(np.array([4.0, 5.0]), {"columns": ["y"]}) == {"y": [4.0, 5.0]}
    with pytest.raises(FieldError, match="no field q"):
        readers.dataset_columns(a, spec | {"fields": {"x": "q"}})


def test_handles_take_numbers_on_either_side(session):
    got = (2 ** (1 - session.g.gap) / 4 - -session.g.gap).to_pandas()
    assert np.allclose(got["value"], 2 ** (1 - got["U"] * got["n"]) / 4 + got["U"] * got["n"])


def test_bad_tables(tmp_path, session):
    (tmp_path / "x.dat").write_text("1 2 3\n")
    spec = {"source": {"pattern": "{k:str}.dat", "reader": {"format": "text", "columns": ["T", "E"]}}, "field": {"inputs": ["k", "T"], "axis": "T"}}
    session.add_table("x", Table.declared("x", spec, str(tmp_path)))
    with pytest.raises(Exception, match="3 columns, 2 were declared"):
        session.eval("x.E").to_pandas()
    with pytest.raises(FieldError, match="unknown key"):
        Table.declared("y", {"source": {"patern": "a"}, "field": {"inputs": []}}, ".")
