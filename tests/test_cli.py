import json

import pytest

from lodestone import cli


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("LODESTONE_DIR", str(tmp_path / "store"))

    def call(*args, code=0):
        assert cli.main(list(args), spark) == code
        out = capsys.readouterr().out
        rows = [json.loads(line) for line in out.splitlines()]
        return rows[0] if args[0] in ("status", "ingest") else rows if code == 0 else None

    return call


def test_commands(run, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "note.txt").write_text("The rent of the flat is due on the first. " * 5)
    assert run("status")["documents"] == 0
    assert run("ingest", str(root))["added"] == 1
    assert [d["filename"] for d in run("documents")] == ["note.txt"]
    assert run("ask", "when is the rent due", "--plain")[0]["sources"][0]["filename"] == "note.txt"
    assert run("summarize", "1")[0]["summary"]
    assert {d["kind"] for d in run("details", "mail a@b.org, call +49 30 123 4567")} == {"email", "phone"}
    assert run("actions", "Anna must call Bo.") == []
    assert run("remind", "remind me to pay rent tomorrow")[0]["title"] == "pay rent"
    assert len(run("reminders")) == 1 and run("reminders", "--done", "1") == []
    assert run("remind", "no date", code=1) is None
    assert run("folders", "--set", str(root), "no_access")[0]["access_level"] == "no_access" and run("documents") == []
    assert run("folders", "--remove", "1") == []
