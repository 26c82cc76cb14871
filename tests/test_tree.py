"""Ignore rules, and scans of folders made for the test."""

import json
import os

import pytest

from graphmill.sources import tree


@pytest.mark.parametrize(
    "rules, path, is_folder, want",
    [
        (["*.log"], "a/b.log", False, True), (["*.log", "!keep.log"], "a/keep.log", False, False), (["/a.py"], "b/a.py", False, False), (["/a.py"], "a.py", False, True), (["build/"], "x/build", True, True), (["build/"], "build", False, False),
        (["a/b"], "a/b", True, True), (["a/b"], "x/a/b", True, False), (["**/b"], "x/y/b", False, True), (["a/**"], "a/x/y", False, True), (["a/**/z"], "a/z", False, True), (["a/**/z"], "a/b/c/z", False, True), (["f?o"], "foo", False, True), (["f?o"], "f/o", False, False),
        (["[ab].c"], "x/a.c", False, True), (["[!ab].c"], "a.c", False, False), (["# no"], "# no", False, False), ([r"\#yes"], "#yes", False, True), ([r"\!yes"], "!yes", False, True), (["tail  "], "tail", False, True), (["[never"], "[never", False, False), ([""], "a", False, False), (["*"], "a/b", True, True), (["x\r"], "x", False, True),
    ],
)
def test_rules(rules, path, is_folder, want):
    assert tree.ruled_out(path, is_folder, tuple(rules)) == want


def make(root, **files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def scanned(spark, root, **options):
    return sorted(r["path"] for r in tree.scan_tree(spark, str(root), **options).select("path").collect())


def test_a_tree_with_nested_rules_and_repositories(spark, tmp_path):
    make(tmp_path, **{
        "a.py": "1", "readme.md": "no source", ".gitignore": "ignored/\n*.gen.py\n!vendor/\n", "x.gen.py": "", "ignored/secret.py": "", "node_modules/m/index.js": "", "vendor/v.go": "package v",
        "sub/.gitignore": "/local.py\ndeep/*.js\n", "sub/local.py": "", "sub/kept.py": "", "sub/deep/x.js": "", "sub/deep/y.py": "", "sub/other/local.py": "",
        "repo/.git/HEAD": "", "repo/.gitignore": "mine.py\n", "repo/mine.py": "", "repo/its.gen.py": "", "repo/node_modules/z.js": "", "tree2/.git": "gitdir: /x/.git/worktrees/w\n", "tree2/copy.py": "", "module/.git": "gitdir: ../.git/modules/m\n", "module/m.py": "",
        "ignored/clone/.git/HEAD": "", "ignored/clone/c.py": "", "ignored/a/b/c/d/far/.git/HEAD": "", "ignored/a/b/c/d/far/f.py": "", "bad/.gitignore": b"\xff\x00\x01*.py", "bad/b.py": "",
    })
    base = ["a.py", "bad/b.py", "module/m.py", "repo/its.gen.py", "sub/deep/y.py", "sub/kept.py", "sub/other/local.py", "vendor/v.go"]
    for partitions in (1, 2, 5, 64):
        assert scanned(spark, tmp_path, partitions=partitions) == base
    assert scanned(spark, tmp_path, include_ignored=["ignored/"]) == sorted([*base, "ignored/clone/c.py"])
    assert scanned(spark, tmp_path, exclude=["sub/", "**/m.py", "repo"]) == ["a.py", "bad/b.py", "vendor/v.go"]
    assert scanned(spark, tmp_path, extensions={"MD": "python", "a.b": "go", "q": "unheard"}) == sorted([*base, "readme.md"])
    make(tmp_path, **{"graphmill.json": json.dumps({"exclude": ["sub/", " ", 3], "extensions": {".md": "python"}, "includeIgnored": "no list"})})
    assert scanned(spark, tmp_path) == sorted(["readme.md", *(p for p in base if not p.startswith("sub/"))])
    make(tmp_path, **{"graphmill.json": "{ broken"})
    assert scanned(spark, tmp_path) == base


def test_contents_errors_and_links(spark, tmp_path):
    root = tmp_path / "root"
    make(root, **{"ok.py": "é = 1", "big.py": "x" * (tree.LARGEST + 1), "bad.py": b"\xff\xfe", "empty.py": "", "d/e.py": "1"})
    make(tmp_path, **{"outside/o.py": ""})
    os.symlink(tmp_path / "outside", root / "out")
    os.symlink(root / "d", root / "again")
    os.symlink(root, root / "d" / "up")
    os.symlink(root / "gone", root / "broken.py")
    got = {r["path"]: r for r in tree.scan_tree(spark, f"file://{root}").collect()}
    assert set(got) == {"ok.py", "big.py", "bad.py", "empty.py", "d/e.py", "again/e.py"}
    assert (got["ok.py"]["text"], got["ok.py"]["language"], got["ok.py"]["size"], len(got["ok.py"]["content_hash"]), got["ok.py"]["error"]) == ("é = 1", "python", 6, 64, None)
    assert (got["big.py"]["text"], got["big.py"]["content_hash"], got["big.py"]["error"]) == (None, None, "larger than 1 MB")
    assert (got["bad.py"]["text"], got["bad.py"]["error"], got["empty.py"]["text"]) == (None, "not UTF-8", "")


def test_ignored_folders_are_never_opened():
    paths = {"": [("src", 1), ("build", 1), ("skip", 1), (".gitignore", 0)], "src/": [("a.py", 0), ("gen", 1), (".gitignore", 0)], "src/gen/": [], "build/": [], "skip/": []}
    opened = []

    def list_(path):
        opened.append(path)
        return [tree.Entry(n, bool(d), 1, 0) for n, d in paths[path]]

    t = tree.Tree(list_, lambda path: {".gitignore": b"skip/", "src/.gitignore": b"gen"}[path])
    assert [p for p, _ in t.walk(tree.Folder("", ()))] == [".gitignore", "src/.gitignore", "src/a.py"] and opened == ["", "src/"]
