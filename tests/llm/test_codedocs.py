import pytest

from sheaf.llm import codedocs as cd


def kept(source, language):
    return [(d["start_line"], d["name"]) for d in cd.definitions(source, language) if cd.says_something(d["doc"], d["name"])]


def test_python():
    source = 'def a(x):\n    """Adds seven."""\n\nclass B:\n    """No."""\n    async def c(\n        self,\n    ):\n        r\'\'\'Opens gates.\'\'\'\n        s = "def no(): pass"\n        """Not documentation."""\n\n# Says much\ndef d():\n    return 1\n'
    assert kept(source, "python") == [(1, "a"), (6, "c")]
    assert [d["kind"] for d in cd.definitions(source, "python")] == ["function", "method", "function"]


@pytest.mark.parametrize(
    "language, source, want",
    [
        ("script", "/** Opens gates. */\nexport default async function go(a, b) {\n  log('function no() {');\n}\n", [(2, "go")]),
        ("script", "/** Opens gates. */\n\nfunction go() {}\n", []),
        ("script", "class A {\n  // Opens gates.\n  // Twice.\n  static run(x): string {\n    if (x) { y(); }\n  }\n}\n", [(4, "run")]),
        ("script", "// eslint-disable-next-line\nfunction go() {}\n", []),
        ("script", "// x = run(1);\nfunction go() {}\n", []),
        ("script", "// ==== gates ====\nfunction go() {}\n", []),
        ("script", "/** Opens gates. */\nconst go = async (x) => { return x; };\n", [(2, "go")]),
        ("go", "// Opens gates.\nfunc (s *T) Run(a string) (string, error) {\n}\n", [(2, "Run")]),
        ("rust", "/// Opens gates.\n#[must_use]\npub(crate) fn run<'a>(x: &'a str) -> Option<u32> {\n}\n", [(3, "run")]),
        ("rust", "/// About a type.\nimpl T {\n}\n", []),
        ("java", "class A {\n  /** Opens gates. */\n  @Deprecated\n  public List<String> run(String v) throws IOException {\n    // note here\n    log(\"x\");\n  }\n}\n", [(4, "run")]),
        ("c", "/*\n * Opens gates.\n */\nstatic inline char *\nrun(const char *v)\n{\n}\n", [(5, "run")]),
        ("c", "/* Opens gates. */\nint run(int v);\n", []),
    ],
)
def test_languages(language, source, want):
    assert kept(source, language) == want


@pytest.mark.parametrize("doc", ["", "TODO", "TODO: document this", "FIXME add docs", "N/A", "-", "...", "XXX", "tbd", "@param x\n@returns", "sort river", "Sorts the rivers.", "This method sorts the river.", "sort_river()", "sort_river: sort river", "Args:\n"])
def test_says_nothing(doc):
    assert not cd.says_something(doc, "sort_river")


@pytest.mark.parametrize("doc", ["Sorts rivers by length.", "TODO(x): speed up.\nReturns seven.", "@param x the length\nReturns all of them."])
def test_says_something(doc):
    assert cd.says_something(doc, "sort_river")


def test_mixed_line_ends_count_once():
    assert kept('x = 1\r\ny = 2\rdef f():\n    """Adds seven."""\r\n', "python") == [(3, "f")]
