import json
import logging
import threading
import urllib.error
import urllib.request

import pytest

from cladeframe import service
from cladeframe.functions import telemetry
from cladeframe.sources import yaml_io as Y

JOB = {"name": "n", "email": "e@x.org", "queryFileId": 7, "modelId": "6f2e1c1e-93a5-3d51-8a4e-0d6d6a3f9a10", "workDir": "w", "outputFormat": "yaml"}


@pytest.fixture
def site(tmp_path):
    settings = Y.Service.of({"fs": {"serveDirectory": str(tmp_path)}, "models": [{"id": JOB["modelId"], "name": "m", "modelPath": "/m"}], "server": {"address": "127.0.0.1", "port": 0}})
    with service.server(settings) as bound:
        threading.Thread(target=bound.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{bound.server_port}", tmp_path / "public"
        bound.shutdown()


def ask(url, data=None, **headers):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, headers=headers, method="GET" if data is None else "POST"), timeout=20) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def form(content: bytes, name: str = "q.fasta", field: str = "file"):
    body = b"--xYz\r\nContent-Disposition: form-data; name=\"%s\"; filename=\"%s\"\r\n\r\n%s\r\n--xYz--\r\n" % (field.encode(), name.encode(), content)
    return {"data": body, "Content-Type": "multipart/form-data; boundary=xYz"}


def test_a_job_goes_through_the_routes(site):
    url, public = site
    status, body = ask(f"{url}/wd", b"")
    work = json.loads(body)["workDirId"]
    assert status == 201 and (public / work).is_dir()
    assert ask(f"{url}/wd/{work}") == (204, b"")
    content = b">a\r\nACGT\r\n--xYnot\r\n" * 200_000  # more than one piece, with a near miss of the boundary
    assert ask(f"{url}/wd/{work}", **form(content))[0] == 201
    assert (public / work / "input" / "q.fasta").read_bytes() == content
    assert ask(f"{url}/wd/{work}", **form(b"new"))[0] == 409
    assert ask(f"{url}/wd/{work}?force=true", **form(b"new", "../q.fasta"))[0] == 201
    (entry,) = json.loads(ask(f"{url}/wd/{work}")[1])
    assert (entry["name"], entry["size"]) == ("input/q.fasta", 3)
    assert ask(f"{url}/wd/{work}/{entry['id']}") == (200, b"new")
    assert ask(f"{url}/wd/{work}/{entry['id'] + 1}") == (204, b"")
    assert ask(f"{url}/wd/{work}/config", json.dumps(JOB).encode())[0] == 201
    assert Y.Job.read(str(public / work / "config.yaml")).model_id == JOB["modelId"]


def test_what_is_refused(site):
    url, public = site
    assert ask(f"{url}/anything") == (200, b"healthy")
    assert json.loads(ask(f"{url}/models")[1]) == [{"id": JOB["modelId"], "name": "m", "modelPath": "/m"}]
    for name in ("none", "..", "%2e%2e%2fpublic"):
        assert ask(f"{url}/wd/{name}")[0] == 404
    work = json.loads(ask(f"{url}/wd", b"")[1])["workDirId"]
    for body in (b"{}", b"[]", b"x", json.dumps({**JOB, "modelId": "m"}).encode()):
        assert ask(f"{url}/wd/{work}/config", body)[0] == 400
    assert not (public / work / "config.yaml").exists()
    cut = form(b"abc")
    assert ask(f"{url}/wd/{work}", **{**cut, "data": cut["data"][:-12]})[0] == 400
    assert ask(f"{url}/wd/{work}", b"abc")[0] == 400
    assert not list(public.glob(f"{work}/input/*"))


def test_job_log(tmp_path):
    with telemetry.job_log(tmp_path / "logging.jsonl"):
        telemetry.event(telemetry.STARTED, job='a "b"')
    telemetry.event(telemetry.ENDED)
    (line,) = (tmp_path / "logging.jsonl").read_text().splitlines()
    found = json.loads(line)
    assert found["fields"] == {"message": telemetry.CODES["UCPLACE0001"], "code": "UCPLACE0001", "job": 'a "b"'} and found["level"] == "INFO"
    assert not logging.getLogger("cladeframe").handlers and "-" not in telemetry.run_id()
