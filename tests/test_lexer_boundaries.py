"""Blanking against a plain scanner that goes letter by letter, and dynamic calls in the texts they are known from."""

import random

import pytest

from graphmill.functions.lexer import code_only, without_comments
from graphmill.operators import boundaries, intervals


def plain(text, language):
    """Comments blanked, one letter at a time."""
    out, i, n = list(text), 0, len(text)

    def blank(a, z):
        for k in range(a, z):
            out[k] = "\n" if text[k] == "\n" else " "

    def string(i, quote, lines, escapes=True):
        i += 1
        while i < n and text[i] != quote:
            if escapes and text[i] == "\\" and i + 1 < n:
                i += 2
            elif text[i] == "\n" and not lines:
                return i
            else:
                i += 1
        return min(n, i + 1)

    family = {"typescript": "javascript", "c": "java"}.get(language, language)
    spans = {"javascript": "`", "java": "`", "rust": '"', "go": "`"}.get(family, "")
    quotes = {"java": '"`', "python": "\"'", "ruby": "\"'", "rust": "\"'"}.get(family, "\"'`")
    while i < n:
        rest, start = text[i:], i
        if family == "python" and rest[:3] in ('"""', "'''"):
            i += 3
            while i < n and text[i : i + 3] != rest[:3]:
                i += 2 if text[i] == "\\" and i + 1 < n else 1
            i = min(n, i + 3)
            blank(start, i)
        elif family == "ruby" and rest.startswith("=begin") and not text[text.rfind("\n", 0, i) + 1 : i].strip(" \t"):
            lines = text[i:].split("\n")
            k = next((k for k, x in enumerate(lines) if k and x.lstrip(" \t").startswith("=end")), len(lines) - 1)
            i += len("\n".join(lines[: k + 1]))
            blank(start, i)
        elif family not in ("python", "ruby") and rest.startswith("/*"):
            i, depth = i + 2, 1
            while i < n and depth:
                if text.startswith("*/", i):
                    i, depth = i + 2, depth - 1
                elif family == "rust" and text.startswith("/*", i):
                    i, depth = i + 2, depth + 1
                else:
                    i += 1
            blank(start, min(i, n))
        elif family not in ("python", "ruby") and rest.startswith("//") or family in ("python", "ruby", "php") and rest[0] == "#":
            i = text.find("\n", i) if "\n" in rest else n
            blank(start, i)
        elif rest[0] in quotes:
            i = string(i, rest[0], rest[0] in spans, not (family == "go" and rest[0] == "`"))
        else:
            i += 1
    return "".join(out)


PARTS = ["/*", "*/", "//", "#", '"', "'", "`", "\\", "\n", " ", "a", '"""', "'''", "=begin", "=end", "\n=begin", "\n  =end x", "é", "[k](", "b(1)"]


@pytest.mark.parametrize("language", ["python", "ruby", "rust", "php", "go", "typescript", "java", "c"])
def test_comments_are_blanked_as_a_plain_scanner_does(language):
    rng = random.Random(language)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert without_comments(text, language) == plain(text, language), text
        for got in (without_comments(text, language), code_only(text, language)):
            assert [i for i, x in enumerate(got) if x == "\n"] == [i for i, x in enumerate(text) if x == "\n"] and len(got) == len(text)
            assert all(a == b or b == " " for a, b in zip(text, got))


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("route('a') # route('b')", "python", "route('a')             "),
        ('def f():\n    """doc\n    """\n    x', "python", "def f():\n" + " " * 10 + "\n" + " " * 7 + "\n    x"),
        ("x = 1 /* a /* b */ c */ y", "rust", "x = 1                   y"),
        ("s := `// raw` // gone", "go", "s := `// raw`        "),
        ("'// kept' // gone", "typescript", "'// kept'        "),
        ("anything // stays", "cobol", "anything // stays"),
    ],
)
def test_blanked_texts(text, language, want):
    assert without_comments(text, language) == want


def forms(text, language):
    return [(s[1], s[4]) for s in boundaries.sites_of(text, language)]


@pytest.mark.parametrize(
    "text, language, want",
    [
        ("function go(p) {\n  table['save'](p);\n}", "typescript", [("computed-call", "save")]),
        ("this.handlers[action.type](action.payload)", "typescript", [("computed-call", None)]),
        ('// this.handlers[a.type](p)\nconst d = "call handlers[key](p) to dispatch";', "typescript", []),
        ("const a = xs[0]; const b = [1, 2, 3]; return a + b[1]", "typescript", []),
        ("return getattr(self, name)(1)", "python", [("getattr-call", None)]),
        ("handler = getattr(self, 'handle_' + kind)\nreturn handler(p)", "python", [("getattr-assign", "handle_")]),
        ("handler = getattr(self, 'handle_' + kind)\nreturn handler", "python", []),
        ("getattr(self, request.method.lower(),\n   self.not_allowed)(x)", "python", [("getattr-call", None)]),
        ("target.send(:handle_save, 1)", "ruby", [("ruby-send", "handle_save")]),
        ("return await _mediator.Send(new CreateTodoItemCommand(c));", "csharp", [("typed-bus", "CreateTodoItemCommand")]),
        ("this.emitter.emit(name, data);", "typescript", [("var-key-dispatch", None)]),
        ("this.emitter.emit('saved', data);", "typescript", []),
        ('o.getClass().getMethod("handlePing").invoke(o);', "java", [("reflection", "handlePing"), ("reflection", None)]),
        ("import(path)", "javascript", [("dynamic-import", None)]),
        ("import('./a')", "javascript", []),
        ("importlib.import_module(x)", "python", [("dynamic-import", None)]),
        ("call_user_func([$this, 'run'], 1);", "php", [("php-dynamic", "run")]),
        ("new Proxy(a, b); Reflect.get(a, k)", "javascript", [("proxy-reflect", None), ("proxy-reflect", None)]),
        ("#selector(Owner.tapped)", "swift", [("selector", "tapped")]),
    ],
)
def test_sites(text, language, want):
    assert forms(text, language) == want


def test_boundaries_of_functions(spark):
    text = "class R {\n  routeSave(p) {\n    this.table['save'](p);\n    this.t[a](p);\n    this.t[b](p);\n  }\n  run(h) { h[x](1) }\n}"
    files = spark.createDataFrame([("a.ts", text, "typescript"), ("b.ts", None, "typescript"), ("c.py", "h = getattr(o, n)\n\n\ndef f():\n    h(1)", "python")], "path string, text string, language string")
    scopes = spark.createDataFrame([("R", "a.ts", 1, 8), ("save", "a.ts", 2, 6), ("run", "a.ts", 7, 7), ("first", "c.py", 1, 2), ("f", "c.py", 4, 5)], "scope string, file_path string, start int, end int")
    got = {(r["scope"], r["key"]): r for r in boundaries.boundaries(files, scopes).collect()}
    assert set(got) == {("save", "save"), ("save", None), ("run", None)}
    assert (got["save", "save"]["line"], got["save", None]["more_sites"], got["save", None]["line"]) == (3, 1, 4)
    assert boundaries.boundaries(files, scopes, most=1).count() == 2
    nodes = spark.createDataFrame([("n1", "onSave", "function"), ("n2", "save", "method"), ("n3", "saved", "method")], "id string, name string, kind string")
    found = boundaries.candidates(boundaries.boundaries(files, scopes), nodes)
    assert [r["target"] for r in found.orderBy("target").collect()] == ["n1", "n2"]


def test_a_wide_range_is_two_rows(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 1_000_000), (3, "f", 7), (4, "g", 7), (5, "f", None)], "id int, key string, at int")
    ranges = spark.createDataFrame([(10, "f", 1, 2_000_000_000), (11, "f", 5, 6), (12, "f", 7, 7), (13, "f", 9, 2)], "scope int, key string, start int, end int")
    got = {r["id"]: r["scope"] for r in intervals.enclosing(points, ranges, "key", "at").collect()}
    assert got == {1: 11, 2: 10, 3: 12, 4: None, 5: None}
    assert {r["scope"] for r in intervals.enclosing(points, ranges.limit(0), "key", "at").collect()} == {None}
