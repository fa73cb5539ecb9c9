import os
import subprocess

import pytest

from commitlens import cli
from commitlens.options import ReportOptions, parse
from commitlens.plans import hotspots
from commitlens.sources import git, tree


def run(*command, cwd):
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"}
    subprocess.run(command, cwd=cwd, check=True, capture_output=True, env=env)


def commit(repo, files):
    for path, text in files.items():
        target = repo / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())
    run("git", "add", "-A", cwd=repo)
    run("git", "commit", "-q", "-m", "change\n\ncommit 0123456789012345678901234567890123456789", cwd=repo)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    repo = tmp_path_factory.mktemp("repo")
    run("git", "init", "-q", cwd=repo)
    commit(repo, {"src/a.rs": "fn one() {\n}\n\nfn two() {\n}\n", "b.go": "package p\n\nfunc F() {\n}\n\nfunc (f x) G() {\n}\n", "c.lua": "function h()\nend\n"})
    commit(repo, {"src/a.rs": "fn one() {\n    1;\n}\n\nfn two() {\n}\n"})
    commit(repo, {"src/a.rs": "fn one() {\n    2;\n}\n\nfn two() {\n}\n", "c.lua": "function h()\n  x()\nend\n"})
    (repo / "new.lua").write_text("function fresh() end\n")
    (repo / ".hidden.rs").write_text("fn no() {}\n")
    (repo / "bad.rs").write_bytes(b"fn bad() {} // \xff\n")
    os.symlink("missing", repo / "gone.rs")
    return repo


def test_tree(spark, tmp_path):
    assert tree.scan(spark, str(tmp_path)).collect() == []
    for p in ("a.go", "b.rs", "d/c.lua", "d/.e/f.txt", ".x", "d/_g.rs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    os.symlink(tmp_path / "d", tmp_path / "link")
    got = {(r.path, r.lang) for r in tree.scan(spark, str(tmp_path)).collect()}
    assert got == {("./a.go", "go"), ("./b.rs", "rust"), ("./d/c.lua", "lua"), ("./d/.e/f.txt", "undefined"), ("./d/_g.rs", "rust"), ("./link", "undefined")}
    assert [r.path for r in tree.scan(spark, str(tmp_path), ["./d"], [".e", "_g"]).collect()] == ["./d/c.lua"]


def test_folders_are_dealt_out_and_pruned(tmp_path):
    for k in range(40):
        (tmp_path / f"big/sub{k}/deep").mkdir(parents=True)
        (tmp_path / f"big/sub{k}/deep/f.go").write_text("")
        (tmp_path / f"big/sub{k}/g.go").write_text("")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/x.go").write_text("")

    def read(*below):
        reader = tree.TreeReader(str(tmp_path), below)
        parts = reader.partitions()
        return parts, [p for part in parts for (p,) in reader.read(part)]

    parts, paths = read()
    assert len(parts) > 40 and len(paths) == len(set(paths)) == 81
    parts, paths = read("big/sub3/deep")
    assert {p for p in paths} == {"./big/sub3/g.go", "./big/sub3/deep/f.go"} and all(tree.may_hold(p.path, ("big/sub3/deep",)) for p in parts)
    assert not tree.may_hold("big/sub33", ("big/sub3",)) and tree.may_hold("", ("a",)) and tree.may_hold("a/b", ("a",))


def test_messages(spark, repo, caplog):
    with caplog.at_level("DEBUG", logger="commitlens"):
        hotspots.run(spark, ReportOptions(root=str(repo), exclude_func=("two",)))
    said = caplog.text
    assert "./bad.rs: not_utf8" in said and "./gone.rs: unreadable" in said and "rust: 2 functions, 1 left out by name" in said and "files listed in" in said
    caplog.clear()
    with caplog.at_level("ERROR", logger="commitlens"):
        hotspots.run(spark, ReportOptions(root=str(repo)))
    assert not caplog.text


def test_report(spark, repo):
    rows = [tuple(r) for r in hotspots.run(spark, ReportOptions(root=str(repo))).collect()]
    assert rows == [
        ("./src/a.rs", 1, "one", 3), ("./c.lua", 1, "h", 2), ("./b.go", 3, "F", 1), ("./src/a.rs", 4 + 1, "two", 1),
        ("./b.go", 6, "(x) G", 0), ("./new.lua", 1, "fresh", 0)]
    some = hotspots.run(spark, ReportOptions(root=str(repo), prefix=("src",), exclude_func=("tw",)))
    assert [r.name for r in some.collect()] == ["one"]
    assert [r.name for r in hotspots.run(spark, ReportOptions(root=str(repo), skip=1, total=1, invert_match=(".go",))).collect()] == ["h"]
    with pytest.raises(hotspots.NoFilesFound):
        hotspots.run(spark, ReportOptions(root=str(repo), prefix=("nowhere",)))


def test_only_unsupported_files(spark, repo):
    (repo / "notes").mkdir(exist_ok=True)
    (repo / "notes/x.txt").write_text("x")
    assert hotspots.run(spark, ReportOptions(root=str(repo), prefix=("notes",))).collect() == []


def test_not_a_repository(spark, tmp_path):
    with pytest.raises(git.NotARepository):
        hotspots.run(spark, ReportOptions(root=str(tmp_path)))


def test_statuses(repo):
    assert git.log_of(str(repo), "./new.lua", "fresh")[1] == "untracked"
    assert git.log_of(str(repo), "./b.go", "(x) G")[1] == "no_match"
    assert git.log_of(str(repo), "./b.go", "(*G[K, M")[1] == "bad_regex"
    assert git.log_of(str(repo), "./b.go", "F")[1] == "ok"


def test_name_is_a_pattern(repo):
    """A name binds to the first line that it matches; in literal mode its characters are themselves."""
    assert git.log_of(str(repo), "./src/a.rs", "o.e")[1] == "ok"
    assert git.log_of(str(repo), "./src/a.rs", "o.e", "literal")[1] == "no_match"


def test_options():
    assert parse([]) == ReportOptions()
    o = parse(["-t", "3", "-s", "1", "-VV", "-p", "a", "b", "-v", "c", "-F", "d", "-r", "/x"])
    assert o == ReportOptions(3, 1, 2, ("a", "b"), ("c",), ("d",), "/x")
    assert parse(["version"]).command == "version"
    with pytest.raises(SystemExit):
        parse(["-t", "-1"])


def test_version_and_table(capsys):
    assert cli.main(["version"]) == 0
    assert capsys.readouterr().out.startswith("version: 0.1.0, git commit: ")
    assert cli.table([("./a", 1, "f", 2)]).splitlines()[0].split() == ["FILE", "LINE", "FUNCTION", "FREQUENCY"]
