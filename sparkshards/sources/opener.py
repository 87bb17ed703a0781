"""Opening URLs from any task: local files, http(s), Hadoop-like filesystems, pipes, caches."""

from __future__ import annotations

import hashlib
import io
import os
import re
import shutil
import subprocess
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote, urlsplit

from ..functions.errors import FormatError, SecurityError, SubprocessError, Unsupported
from .tario import magic_type

Handler = Callable[[str, str], BinaryIO]
_schemes: dict[str, Handler] = {}


def scheme(url: str) -> str | None:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    return m[1].lower() if m else None


def url_path(url: str) -> str:
    return urlsplit(url).path if scheme(url) else url


def is_local(url: str) -> bool:
    return scheme(url) in (None, "file")


def to_local_path(url: str) -> str | None:
    if scheme(url) is None:
        return url
    if scheme(url) == "file":
        rest = url[5:]
        return unquote("/" + rest.lstrip("/") if rest.startswith("//") else rest)
    return None


def percent_encode(text: str) -> str:
    return quote(text, safe="")


def percent_decode(text: str) -> str:
    return unquote(text)


def rewrite_url(url: str, rules: str | None) -> str:
    """``prefix=replacement;...``; the first that fits is used."""
    for rule in (rules or "").split(";"):
        old, eq, new = rule.partition("=")
        if eq and old and url.startswith(old):
            return new + url[len(old) :]
    return url


def resolve_hub_url(url: str, host: str = "https://huggingface.co") -> str:
    """hf://[datasets/|spaces/]owner/name[@revision]/path as a download address."""
    m = re.fullmatch(r"hf:(?://)?((?:datasets/|spaces/)?[^/]+/[^/@]+)(?:@([^/]+))?/(.+)", url)
    if not m:
        raise FormatError(f"bad hub address {url!r}")
    return f"{host}/{m[1]}/resolve/{m[2] or 'main'}/{m[3]}"


def url_to_cache_name(url: str, ndir: int = 0) -> str:
    """The last parts of the path behind a hash of the whole, so that equal basenames never meet."""
    mark = hashlib.sha256(url.encode()).hexdigest()[:16]
    if scheme(url) in (None, "file", "http", "https", "ftp", "gs", "s3", "s3a", "hdfs", "ais"):
        parts = [p for p in url_path(url).split("/") if p][-(ndir + 1) :]
        parts[-1:] = [f"{mark}-{parts[-1]}"] if parts else [mark]
        return "/".join(parts)
    return mark + "-" + percent_encode(url)[-128:]


class _Pipe(io.RawIOBase):
    """A command's output or input; its exit status is checked at the end.  A text is for the shell, a list runs as it is."""

    def __init__(self, command: str | list[str], mode: str, ignored: tuple[int, ...] = (0, 141)):
        write = "w" in mode
        self.ignored, self.command = ignored, command
        self.process = subprocess.Popen(["/bin/sh", "-c", command] if isinstance(command, str) else command, stdin=subprocess.PIPE if write else None, stdout=None if write else subprocess.PIPE)
        self.pipe = self.process.stdin if write else self.process.stdout
        self.ended = False

    def readable(self) -> bool:
        return self.pipe.readable()

    def writable(self) -> bool:
        return self.pipe.writable()

    def readinto(self, out) -> int:
        data = self.pipe.read(len(out))
        out[: len(data)] = data
        if not data:
            self._end()
        return len(data)

    def write(self, data) -> int:
        return self.pipe.write(data)

    def _end(self) -> None:
        if not self.ended:
            self.ended = True
            self.pipe.close()
            status = self.process.wait()
            status = 128 - status if status < 0 else status
            if status not in self.ignored:
                raise SubprocessError(f"{self.command!r} ended with {status}")

    def close(self) -> None:
        if not self.closed:
            super().close()
            self._end()


def register_scheme(name: str, handler: Handler) -> None:
    """A handler takes (url, mode); replaces what was there.  Pass ``schemes()`` along to reach executors."""
    _schemes[name.lower()] = handler


def schemes() -> dict[str, Handler]:
    return dict(sorted(_schemes.items()))


#: Schemes that a program transfers: its arguments for reading and for writing, and its harmless exit codes (a reader that stops early).
TRANSFERS: dict[str, tuple[list[str], list[str] | None, tuple[int, ...]]] = {
    **{kind: (["curl", "-sSfL", "{url}"], ["curl", "-sSfL", "-T", "-", "{url}"], (0, 23, 26, 141)) for kind in ("http", "https", "ftp", "ftps", "sftp", "scp")},
    "ais": (["ais", "get", "{url}", "-"], ["ais", "put", "-", "{url}"], (0, 141)),
}


def reroute(url: str, schemes_: str | None) -> str:
    """``gs:s3``: buckets of these schemes are read through ais."""
    kind = scheme(url)
    return f"ais://{url.split('://', 1)[1]}?provider={kind}" if kind and "://" in url and kind in (schemes_ or "").split(":") else url


@dataclass
class Opener:
    """What it takes to open URLs; travels to executors."""

    secure: bool = False
    allow_pipe: bool = False
    rewrite: str | None = field(default_factory=lambda: os.environ.get("GOPEN_REWRITE"))
    ais_for: str | None = field(default_factory=lambda: os.environ.get("USE_AIS_FOR"))
    token: str | None = field(default_factory=lambda: os.environ.get("HF_TOKEN"), repr=False)
    memory: dict[str, bytes] = field(default_factory=dict)
    handlers: dict[str, Handler] = field(default_factory=schemes)
    cache_dir: str | None = None
    cache_bytes: int | None = None
    retries: int = 3
    backoff: float = 1.5
    timeout: float = 60.0

    def check(self, url: str) -> None:
        if self.secure and (scheme(url) in (None, "file", "pipe") or self.rewrite):
            raise SecurityError(f"{url!r} is refused in secure mode")

    def open(self, url: str, mode: str = "rb") -> BinaryIO:
        if url in self.memory and "r" in mode:
            return io.BytesIO(self.memory[url])
        self.check(url)
        url = reroute(rewrite_url(url, self.rewrite), self.ais_for)
        kind = scheme(url)
        if "r" in mode and self.cache_dir and not is_local(url) and kind != "pipe":
            return open(self.cached(url), "rb")
        return self._direct(url, mode)

    def _direct(self, url: str, mode: str) -> BinaryIO:
        kind = scheme(url)
        if url == "-":
            return sys.stdin.buffer if "r" in mode else sys.stdout.buffer
        if kind in self.handlers:
            return self.handlers[kind](url, mode)
        if kind == "pipe":
            if not self.allow_pipe:
                raise SecurityError("pipe: needs allow_pipe")
            raw = _Pipe(url[5:], mode)
            return raw if "w" in mode else io.BufferedReader(raw, 1 << 20)
        if is_local(url):
            return open(to_local_path(url), "rb" if "r" in mode else "wb")
        headers = {}
        if kind == "hf":
            url, kind = resolve_hub_url(url), "https"
            headers = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        if kind == "htgs":
            url, kind = "https://storage.googleapis.com/" + url.split(":", 1)[1].lstrip("/"), "https"
        if kind in ("http", "https", "ftp"):
            if "w" not in mode:
                return self._fetched(urllib.request.Request(url, headers=headers))
        if kind in TRANSFERS:
            read, write, ignored = TRANSFERS[kind]
            command = [x.replace("{url}", url) for x in (write if "w" in mode else read)]
            if shutil.which(command[0]) is None:
                raise Unsupported(f"{kind}: needs the program {command[0]}")
            raw = _Pipe(command, mode, ignored)
            return raw if "w" in mode else io.BufferedReader(raw, 1 << 20)
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(url)
        return files.open_input_stream(path, compression=None) if "r" in mode else files.open_output_stream(path, compression=None)

    def _fetched(self, request: urllib.request.Request) -> BinaryIO:
        """An answer; servers that are down or busy are asked again, each time later."""
        for i in range(self.retries):
            try:
                return urllib.request.urlopen(request, timeout=self.timeout)
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code not in (408, 429) or i + 1 == self.retries:
                    raise
            except OSError:
                if i + 1 == self.retries:
                    raise
            time.sleep(min(30.0, self.backoff**i))
        raise FormatError(request.full_url)

    def cached(self, url: str) -> str:
        """The path of a whole copy on this machine; downloads go to a name of their own first."""
        path = os.path.join(self.cache_dir, url_to_cache_name(url))
        if os.path.exists(path):
            return path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        if self.cache_bytes is not None:
            self.clean()
        for i in range(self.retries):
            temp = f"{path}.{os.getpid()}.{i}"
            try:
                with self._direct(url, "rb") as source, open(temp, "wb") as sink:
                    while data := source.read(1 << 20):
                        sink.write(data)
                with open(temp, "rb") as f:
                    if magic_type(f.read(264)) == "unknown":
                        raise FormatError(f"{url} is no archive")
                os.replace(temp, path)
                return path
            except FormatError:
                os.unlink(temp)
                raise
            except OSError:
                if os.path.exists(temp):
                    os.unlink(temp)
                if i + 1 == self.retries:
                    raise
                time.sleep(self.backoff**i)
        raise FormatError(url)

    def clean(self) -> None:
        """Removes the oldest files until the cache is within its budget."""
        found = [(os.path.getctime(p), os.path.getsize(p), p) for d, _, names in os.walk(self.cache_dir) for n in names for p in [os.path.join(d, n)]]
        total = sum(s for _, s, _ in found)
        for _, size, path in sorted(found):
            if total <= self.cache_bytes:
                break
            os.unlink(path)
            total -= size


def gopen(url: str, mode: str = "rb", **options) -> BinaryIO:
    return Opener(**options).open(url, mode)
