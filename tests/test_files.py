import shutil
import zipfile

import pytest

from stratamill.sources import files


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def log(order, known, tail, gap=False):
    """A log whose columns stand in the order given."""
    rows = []
    for i in range(known + tail):
        value = str(100 + i) if i < known or gap and i == known + 3 else ""
        cells = {"MD": i, "X": 1, "Y": 2, "Z": -i, "GR": "" if i % 7 == 0 else 50 + i, "TVT_input": value, "extra": "x"}
        rows.append(",".join(str(cells[c]) for c in order))
    return [",".join(order), *rows]


def test_wells(spark, tmp_path):
    order = ["MD", "X", "Y", "Z", "GR", "TVT_input"]
    reference = ["TVT,GR", *(f"{i},{i}" for i in range(60)), "nan,3"]
    for well, lines in {
        "a": log(order, 60, 10),
        "b": log([*reversed(order), "extra"], 55, 9),
        "gap": log(order, 60, 10, gap=True),
        "short": log(order, 40, 10),
        "lacks": log(order[:-1], 60, 10),
        "alone": log(order, 60, 10),
    }.items():
        write(tmp_path / f"{well}__horizontal_well.csv", lines)
        if well != "alone":
            write(tmp_path / f"{well}__typewel_log.csv", reference)
    found = files.usable_wells(spark, str(tmp_path)).groupBy("well").agg({"known": "count", "MD": "max", "TVT": "count"}).collect()
    assert sorted((r["well"], r["count(known)"], r["max(MD)"], r["count(TVT)"]) for r in found) == [("a", 70, 69.0, 0), ("b", 64, 63.0, 0)]
    first = files.usable_wells(spark, str(tmp_path)).filter("well = 'b' AND MD = 3").first()
    assert (first["Z"], first["GR"], first["TVT_input"], first["known"], first["tail"]) == (-3.0, 53.0, 103.0, True, False)
    listed = {r["well"]: r["n_references"] for r in files.wells(spark, str(tmp_path)).collect()}
    assert listed["a"] == 1 and listed["alone"] == 0 and len(listed) == 6


def test_planes(spark, tmp_path):
    for name in ("x_GAMMA_1.csv", "x_gamma__pulse_.csv", "other.csv"):
        write(tmp_path / "dump" / name, ["a"])
    assert sorted(r["id"] for r in files.dump_planes(spark, str(tmp_path / "dump")).collect()) == ["tool_csv_other", "tool_gamma", "tool_pulse"]
    (tmp_path / "emz").mkdir()
    with zipfile.ZipFile(tmp_path / "emz" / "ok.emz", "w") as z:
        for name in [f"a/wits/{i}" for i in range(7)] + ["Decoder.db"]:
            z.writestr(name, "x")
    (tmp_path / "emz" / "bad.emz").write_text("no archive")
    found = {r["id"]: (r["state"], r["n"], len(r["evidence"])) for r in files.archive_planes(spark, str(tmp_path / "emz")).collect()}
    assert found == {"wits_surface": ("LIVE", 7, 5), "decoder_rt": ("LIVE", 1, 1), "acq_db": ("LIVE", 1, 1), "acq_emz": ("UNKNOWN", 0, 1)}


def test_knowledge_files(spark, tmp_path):
    for name in ("a.md", "b.TXT", "c.bin", "skip/d.md", "deep/e.md", "README.md"):
        write(tmp_path / name, [name])
    names = lambda **more: sorted(r["name"] for r in files.knowledge_files(spark, str(tmp_path), [".md", ".txt"], ["skip"], ["README.md"], **more).collect())
    assert names() == ["a.md", "b.TXT", "e.md"]
    assert names(most_files=1) == ["a.md"] and names(most_bytes=5) == ["a.md"]
    assert {r["text"] for r in files.texts(spark, [str(tmp_path / "a.md")]).collect()} == {"a.md\n"}


def test_writers(spark, tmp_path):
    predicted = spark.createDataFrame([("w_1", 3, 1.5), ("w_1", 4, 2.5)], "well string, row long, tvt double")
    sample = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert {tuple(r) for r in files.submission(sample("w_1_3", "w_1_4"), predicted).collect()} == {("w_1_3", 1.5), ("w_1_4", 2.5)}
    with pytest.raises(ValueError, match="1 rows .* w_1_5"):
        files.submission(sample("w_1_3", "w_1_5"), predicted)
    files.write_once(predicted, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(predicted, str(tmp_path / "out"))
    files.save_index(predicted, str(tmp_path / "index"), "tvt")
    assert files.load_index(spark, str(tmp_path / "index"), vectors=False).columns == ["well", "row"]
    assert files.load_index(spark, str(tmp_path / "index")).count() == 2
    assert files.sealed({"b": 1, "a": [2]}) == files.sealed({"a": [2], "b": 1})
    write(tmp_path / "rows.jsonl", ['{"id": 1}', "", '{"id": 2}'])
    assert sorted(r["id"] for r in files.json_lines(spark, str(tmp_path / "rows.jsonl"), "id long").collect()) == [1, 2]
    assert files.digests(spark, str(tmp_path / "rows.jsonl")).first()["sha256"] == __import__("hashlib").sha256((tmp_path / "rows.jsonl").read_bytes()).hexdigest()


def test_shards_are_resumed_and_audited(spark, tmp_path):
    path, asked = str(tmp_path / "shards"), []

    def compute(fold):
        asked.append(fold)
        return spark.range(fold, fold + 3)

    rows = lambda folds: sorted(map(tuple, files.resume_shards(spark, path, folds, compute).collect()))
    assert rows([0, 1]) == sorted((i + f, f) for i in range(3) for f in (0, 1))
    assert asked == [0, 1]
    assert len(rows([0, 1, 2])) == 9 and asked == [0, 1, 2]
    shutil.rmtree(tmp_path / "shards" / "audit-2")  # a run that ended before its audit
    assert len(rows([0, 1, 2])) == 9 and asked == [0, 1, 2, 2]
    spark.range(5).write.mode("overwrite").parquet(f"{path}/fold-1")
    with pytest.raises(ValueError, match="fold 1"):
        rows([0, 1])
