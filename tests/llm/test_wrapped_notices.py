"""License notices wrapped over comment lines above code."""

import textwrap

import pytest

from cuetide.llm import license


@pytest.mark.parametrize(("mark", "width"), [("# ", 70), (" * ", 50), ("// ", 34), ("rem ", 60)])
def test_wrapped_headers(spark, mark, width):
    code = "\n\nimport sys\n\n" + "\n".join(f"value_{i} = compute(sys.argv[{i}]) + {i}" for i in range(80))
    long = [(name, text) for name, text in license.TEMPLATES if len(text) > 100 and "http" not in text]
    rows = [(at, "#!/bin/sh\n" + "\n".join(mark + line for line in textwrap.wrap(text, width)) + code) for at, (_, text) in enumerate(long)]
    got = {r.at: r for r in license.scan(spark.createDataFrame(rows, "at int, text string")).collect()}
    for at, (name, _) in enumerate(long):
        assert got[at].header_license == name and got[at].header_cosine > 0.99 and got[at].header_line == 1
    bare = license.scan(spark.createDataFrame([(0, code)], "at int, text string")).first()
    assert bare.header_license is None


def test_best_run_equals_every_run():
    known = license.Templates(license.TEMPLATES, license.HEADER_COSINE)
    text = "# a b\n\n" + "\n#\n".join("# " + line for line in textwrap.wrap(license.TEMPLATES[1][1].lower(), 40)) + "\n# zz\nthe code of it\nx = 1"
    lines = [license._TERM.findall(line) for line in text.split("\n")]
    every = max(known.best(sum(lines[i:j], []))[0] for i in range(len(lines)) for j in range(i + 1, len(lines) + 1))
    assert known.best_run(lines)[0] == pytest.approx(every, abs=1e-9)
