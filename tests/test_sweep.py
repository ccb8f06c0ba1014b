"""A sweep over files, some of them broken."""

import json

from kairoframe.sources import sweep


def test_a_broken_file_costs_one_row(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.json").write_text('{"n": 3}')
    (tmp_path / "deep" / "b.json").write_text('{"n": ')
    (tmp_path / "c.json").write_bytes(b"\xff\xfe")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "odd name %.json").write_text('{"n": 4, "m": "x"}')
    (tmp_path / "long.json").write_text('{"n": 1}' + " " * (1 << 20))
    (tmp_path / "other.txt").write_text("no")
    found = {r.path.rsplit("/", 1)[1]: r for r in sweep.swept(spark, f"file://{tmp_path}", "*.json", lambda raw: json.loads(raw.decode()), "n long, m string", most_mb=1).collect()}
    assert set(found) == {"a.json", "b.json", "c.json", "empty.json", "long.json", "odd name %.json"}
    assert (found["a.json"].ok, found["a.json"].n, found["a.json"].m, found["a.json"].bytes, found["a.json"].error) == (True, 3, None, 8, None)
    assert (found["odd name %.json"].n, found["odd name %.json"].m) == (4, "x") and found["empty.json"].error == "empty"
    assert [found[n].ok for n in ("b.json", "c.json", "empty.json", "long.json")] == [False] * 4
    assert "JSONDecodeError" in found["b.json"].error and "UnicodeDecodeError" in found["c.json"].error and found["long.json"].error == "longer than 1 MB"
