import json
from dataclasses import replace

import pytest

from quirelight.operators import prompt as P
from quirelight.operators import settings as S


@pytest.mark.parametrize("change,want", [
    ({}, None), ({"provider": "nobody"}, "provider"), ({"provider": "openai"}, "model"), ({"provider": "openai", "model": "m"}, None), ({"target_language": " "}, "target_language"),
    ({"provider": "openai-compatible", "model": "m"}, "base_url"), ({"provider": "cloudflare", "model": "m"}, "base_url"), ({"provider": "deepl", "target_code": ""}, "target_code"),
    ({"base_url": "ftp://x"}, "base_url"), ({"chunk_chars": 0}, "chunk_chars"), ({"context_chars": -1}, "context_chars"), ({"about": "x" * 2001}, "about"), ({"target_code": "e n"}, "target_code"),
    ({"format": "pdf"}, "format"), ({"output_dir": "/nowhere/at/all"}, "output_dir"), ({"model": "", "provider": "openai", "format": "pdf"}, "model"),
])
def test_first_problem(change, want):
    assert replace(S.Settings(), **change).problem() == want


def test_load_and_save(tmp_path):
    path = str(tmp_path / "c" / "settings.json")
    S.save(replace(S.Settings(), model="m"), path)
    assert S.load(path) == (replace(S.Settings(), model="m"), None)
    (tmp_path / "x.json").write_text(json.dumps({"model": 3, "attempts": 9, "more": 1}))
    got, error = S.load(str(tmp_path / "x.json"))
    assert (got.model, got.attempts, got.unknown, error) == ("", 9, {"more": 1}, None)
    (tmp_path / "y.json").write_text("{")
    assert S.load(str(tmp_path / "y.json"))[0] == S.Settings() and S.load(str(tmp_path / "y.json"))[1]


def test_names(tmp_path):
    s = replace(S.Settings(), output_dir=str(tmp_path), target_code="")
    first = S.output_path("/a/Book.epub", s)
    assert first.name == "Book.french.epub"
    first.touch()
    assert S.output_path("/a/Book.epub", s).name == "Book.french.2.epub"
    S.check_writable(tmp_path / "new")
    with pytest.raises(IsADirectoryError):
        S.check_writable(tmp_path)
    assert S.plain_slug("Große Œuvre à l'été") == "grosse-oeuvre-a-l-ete" and S.plain_slug("!?") == "translated"


def test_services(spark):
    ids = [r.id for r in S.services(spark).collect()]
    assert ids[0] == "anthropic" and ids.index("gemini") < ids.index("ollama") < ids.index("openai") and len(ids) == len(S.SERVICES)
    assert S.key_of("gemini", {"GOOGLE_API_KEY": " k "}) == "k" and S.key_of("ollama", {}) == ""


def test_prompt():
    s = replace(S.Settings(), glossary="whale = baleine")
    assert "French" in P.system_text(s) and "whale = baleine" in P.system_text(s) and P.system_text(s) != P.system_text(s, second=True)
    text = P.user_text(["a<b>", "é"], book="B", passage="One", k=2, n=5, part=1, parts=3, tail="…end")
    assert '["a<b>", "é"]' in text and "Passage 2 of 5: One" in text and "Part 1 of 3" in text
    assert (P.last_runes("abc", 2), P.last_runes("abc", 0), P.last_runes("é", 4)) == ("…bc", "", "é")
    assert P.byte_excerpt("é" * 101) == "é" * 100 + "…" and P.byte_excerpt(" a \n b ") == "a b"


def test_services_and_keys(spark):
    """A service's endpoint unless the settings name one, its first key that is set, its place in the list."""
    assert replace(S.Settings(), provider="mistral").endpoint == "https://api.mistral.ai/v1" and replace(S.Settings(), provider="mistral", base_url=" http://x ").endpoint == "http://x"
    assert S.key_of("gemini", {"GOOGLE_API_KEY": " b "}) == "b" and S.key_of("gemini", {"GEMINI_API_KEY": "a", "GOOGLE_API_KEY": "b"}) == "a" and S.key_of("ollama", {}) == S.key_of("nobody", {}) == ""
    rows = S.services(spark).collect()
    tier = [0 if r.id == S.SERVICES[0][0] else 1 if r.free_tier else 2 if r.no_key else 3 for r in rows]
    assert tier == sorted(tier) and [r.place for r in rows] == list(range(1, len(S.SERVICES) + 1))
    assert replace(S.Settings(), provider="anthropic", model="m", effort="huge").problem() == "effort" and replace(S.Settings(), effort="huge").problem() is None


def test_problems_of_rows(spark):
    rows = spark.createDataFrame([(1, "offline", 4000), (2, "nobody", 0), (3, "offline", 0)], "id int, provider string, chunk_chars int")
    assert {r.id: r.problem for r in S.problems(rows).collect()} == {1: None, 2: "provider", 3: "chunk_chars"}
