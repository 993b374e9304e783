"""The HTTP service: work folders, uploads, job configurations and models. It runs no jobs; the watcher does.

| Route | What |
|---|---|
| POST /wd | makes a work folder |
| GET /wd/{id} | lists its files; 204 before the first upload |
| POST /wd/{id}?force=true | stores an uploaded query file (multipart, field "file") |
| POST /wd/{id}/config | writes the job's configuration, which the watcher waits for |
| GET /wd/{id}/{file} | a file's content by its number; 204 if there is none |
| GET /models | the table of models |
| GET anything else | "healthy" |
"""

from __future__ import annotations

import json
import shutil
import uuid
from collections.abc import Iterator
from email import message_from_bytes
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import BinaryIO
from urllib.parse import parse_qs, unquote, urlsplit

from .sources import files
from .sources import yaml_io as Y

PIECE = 1 << 20


class Body:
    """A request's body, read in pieces up to the places where it is cut."""

    def __init__(self, stream: BinaryIO, size: int):
        self.stream, self.left, self.held = stream, size, b""

    def more(self) -> None:
        piece = self.stream.read(min(self.left, PIECE))
        if not piece:
            raise ValueError("Invalid request")
        self.left -= len(piece)
        self.held += piece

    def until(self, mark: bytes) -> Iterator[bytes]:
        """What stands before the next mark, which is passed over."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) >= len(mark):
                out, self.held = self.held[: 1 - len(mark)], self.held[1 - len(mark) :]
                yield out
            self.more()
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        yield out

    def next(self, size: int) -> bytes:
        while len(self.held) < size:
            self.more()
        out, self.held = self.held[:size], self.held[size:]
        return out

    def parts(self, boundary: str) -> Iterator[tuple[str | None, str | None, Iterator[bytes]]]:
        """(field, file name, content) of the parts of a form; a content is read before the next part."""
        mark = b"--" + boundary.encode()
        for _ in self.until(mark):
            pass
        while self.next(2) != b"--":
            head = message_from_bytes(b"".join(self.until(b"\r\n\r\n")))
            content = self.until(b"\r\n" + mark)
            yield head.get_param("name", header="content-disposition"), head.get_filename(), content
            for _ in content:
                pass


class Handler(BaseHTTPRequestHandler):
    service: Y.Service
    protocol_version = "HTTP/1.1"

    def answer(self, status: int, body: bytes | str | dict | list = b"", kind: str = "text/plain") -> None:
        if isinstance(body, dict | list):
            body, kind = json.dumps(body), "application/json"
        data = body.encode() if isinstance(body, str) else body
        self.send_response(status)
        if status != 204:
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
        if status >= 400:  # what is left of the body isn't read
            self.close_connection = True
            self.send_header("Connection", "close")
        self.end_headers()
        if status != 204:
            self.wfile.write(data)

    def say(self, status: int, text: str) -> None:
        self.answer(status, {"status": status, "msg": text})

    def public(self) -> Path:
        names = self.service.folders()
        return Path(names.serve_directory, names.public_directory)

    def route(self) -> list[str]:
        return [unquote(x) for x in urlsplit(self.path).path.split("/") if x]

    def work_dir(self, name: str) -> Path | None:
        """A work folder; only names are looked up, never paths."""
        at = self.public() / name
        if name != Path(name).name or name == ".." or not at.is_dir():
            self.say(404, "Work directory not exists")
            return None
        return at

    def do_GET(self) -> None:
        match self.route():
            case ["models"]:
                self.answer(200, [m.shown() for m in self.service.model_table()])
            case ["wd", name]:
                if at := self.work_dir(name):
                    given = (at / self.service.folders().input_directory).is_dir()
                    self.answer(200, files.entries(at)) if given else self.answer(204)
            case ["wd", name, number] if number.lstrip("-").isdecimal():
                if at := self.work_dir(name):
                    found = files.by_inode(str(at), int(number) & 0xFFFFFFFF)
                    self.send_file(found) if found else self.answer(204)
            case _:
                self.answer(200, "healthy")

    def do_POST(self) -> None:
        size = self.headers.get("Content-Length") or "0"
        if not size.isdecimal():
            self.answer(400, "Invalid request")
            return
        body = Body(self.rfile, int(size))
        match self.route():
            case ["wd"]:
                self.answer(201, {"workDirId": files.new_work_dir(str(self.public()))})
            case ["wd", name]:
                if at := self.work_dir(name):
                    self.upload(at, body)
            case ["wd", name, "config"]:
                if at := self.work_dir(name):
                    self.configure(at, body)
            case _:
                self.say(404, "No such route")

    def send_file(self, path: Path) -> None:
        with path.open("rb") as content:
            size = path.stat().st_size
            self.send_response(200)
            self.send_header("Content-Type", "application/octet-stream")
            self.send_header("Content-Length", str(size))
            self.end_headers()
            shutil.copyfileobj(content, self.wfile, PIECE)

    def upload(self, at: Path, body: Body) -> None:
        force = parse_qs(urlsplit(self.path).query).get("force") == ["true"]
        boundary = self.headers.get_param("boundary")
        try:
            if not boundary:
                raise ValueError("Invalid request")
            for field, name, content in body.parts(boundary):
                if not name:
                    raise ValueError("Invalid request")
                if field == "file":
                    files.store(str(self.public()), at.name, name, content, force, self.service.folders().input_directory)
            self.say(201, "File saved successfully")
        except FileExistsError as found:
            self.say(409, f"File already exists ({found}). If you want to overwrite it, use the `force` query parameter.")
        except ValueError:
            self.answer(400, "Invalid request")

    def configure(self, at: Path, body: Body) -> None:
        try:
            given = json.loads(body.next(body.left))
            job = Y.Job.of(given)
            uuid.UUID(job.model_id)
            job.query_file_id = int(job.query_file_id)
        except (ValueError, TypeError, AttributeError) as error:
            self.answer(400, f"Invalid configuration: {error}")
            return
        whole = at / f".{uuid.uuid4().hex}"  # the watcher must never see half a configuration
        whole.write_text(job.text())
        whole.rename(at / self.service.folders().config_file_name)
        self.say(201, "Analysis configuration saved successfully")

    def log_message(self, form: str, *args) -> None:
        from .functions.telemetry import log

        log.info(form, *args)


def server(service: Y.Service) -> ThreadingHTTPServer:
    """A server bound to the address and port of the settings; serve_forever() runs it."""
    at = service.server or {}
    return ThreadingHTTPServer((at.get("address", "127.0.0.1"), int(at.get("port", 8080))), type("Bound", (Handler,), {"service": service}))
