import io
import json

from weft import cli

PAGE = "<body><header><nav><a>x</a></nav></header><main><article><h1>t</h1><p>x</p></article></main></body>"


def test_arguments():
    assert cli.parse_args([]) == {}
    assert cli.parse_args(["--validation-file", "v", "--cluster-reasons-file", "r", "--content-block-attribute", "data-x"]) == {"validation_file": "v", "reasons_file": "r", "block_attribute": "data-x"}
    assert cli.parse_args(["-h"]) == {"help": True} and cli.parse_args(["--version"]) == {"version": True}
    assert "requires a value" in cli.parse_args(["--validation-file"])["error"] and "--nope" in cli.parse_args(["--nope", "-h"])["error"]


def test_exit_codes(spark):
    out, log = io.StringIO(), io.StringIO()
    assert cli.run(["--nope"], io.StringIO(), out, log) == 2 and not out.getvalue()
    assert cli.run(["--version"], io.StringIO(), out, log) == 0 and out.getvalue().strip() == cli.VERSION
    assert cli.run([], io.StringIO('{"id": 1}\n'), io.StringIO(), log, spark) == 1 and "error" in log.getvalue()


def test_run(spark, tmp_path):
    rows = [{"id": f"p{i}", "html": PAGE, "paths": ["news", str(i)], "host": "e.example"} for i in range(3)]
    out, log, reasons, checks = io.StringIO(), io.StringIO(), tmp_path / "r.json", tmp_path / "v.json"
    code = cli.run(["--cluster-reasons-file", str(reasons), "--validation-file", str(checks)], io.StringIO("\n".join(map(json.dumps, rows))), out, log, spark)
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert code == 0 and [x["id"] for x in lines] == ["p0", "p1", "p2"] and len({x["clusterKey"] for x in lines}) == 1
    (reason,) = json.loads(reasons.read_text()).values()
    assert reason["memberCount"] == 3 and reason["landmarks"]["header"]["presenceRate"] == 1 and "body>main>article>h1" in reason["structuralCoreTokens"]
    assert json.loads(checks.read_text())["cohesion"][0]["medianPairSimilarity"] == 1 and "1 clusters" in log.getvalue()
