import json

import pytest

from tessellex import cli, config

from .conftest import SMALL


def test_commands(spark, tmp_path, capsys):
    cli.main(["query", "title_dedup", "--data", SMALL, "--out", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    cli.main(["patents", "--dry-run", "--out", str(tmp_path / "p")])
    library = spark.read.csv(str(tmp_path / "p" / "library"), sep="\t", header=True)
    assert {r["name"] for r in library.collect()} == {"Bread making", "Meat mincing", "Dough kneading"} and library.agg({"new_id": "min"}).first()[0] == "11835"
    before = sorted(p.name for p in (tmp_path / "p" / "library").iterdir())
    cli.main(["patents", "--dry-run", "--out", str(tmp_path / "p")])
    assert before == sorted(p.name for p in (tmp_path / "p" / "library").iterdir())
    cli.main(["list"])
    assert "title_dedup" in capsys.readouterr().out


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cluster_least": 3}))
    assert config.load(str(tmp_path / "c.json")).cluster_least == 3 and config.load(None).cluster_least == 7
    (tmp_path / "d.json").write_text(json.dumps({"nothing": 3}))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.json"))
    assert config.lookup({"a": {"b": 1}}, "a.b") == 1 and config.lookup({"a": 1}, "a.b", 7) == 7
