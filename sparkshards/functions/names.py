"""Names and patterns: shard URLs, member names, braces, seeds.

Plain Python for the driver (FN1-FN11, RD5, RD6, SK5) with column forms where a name
is data.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import FormatError, MissingKey, ValueProblem

KEY, URL, LOCAL_PATH, BAD = "__key__", "__url__", "__local_path__", "__bad__"
SHARD_ORD, POS = "__shard_ord__", "__pos__"
#: Variables of ${NAME} in patterns are read from this prefix + NAME.
ENV_PREFIX = "SPARKSHARDS_"
_BASE_EXT = r"^((?:.*/)?[^/.]+)\.([^/]*)$"


def is_meta(name: str) -> bool:
    return name.startswith("__")


def base_plus_ext(path: str) -> tuple[str, str] | None:
    """Splits at the first dot after the last slash; None without a dot or base."""
    m = re.match(_BASE_EXT, path, re.S)
    return (m[1], m[2]) if m else None


def base_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "(?s)" + _BASE_EXT, 1), F.lit(""))


def ext_of(path: Column) -> Column:
    return F.when(base_of(path).isNotNull(), F.regexp_extract(path, "(?s)" + _BASE_EXT, 2))


def is_shard_metadata(name: str) -> bool:
    """``__x__`` as the whole name or as its first folder."""
    top = name.split("/", 1)[0]
    return len(top) > 4 and top.startswith("__") and top.endswith("__") and top[2:].index("__") == len(top) - 4


def is_shard_metadata_col(name: Column) -> Column:
    return F.rlike(name, F.lit(r"(?s)^__(?:[^/_]|_(?!_))+__(?:/.*)?$"))


# -- braces --------------------------------------------------------------------


def _parse_group(text: str, at: int) -> tuple[list[str], int]:
    """The alternatives of the group that opens before ``at``, and the place after it."""
    parts, depth, begin, i = [], 1, at, at
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return [*parts, text[begin:i]], i + 1
        elif c == "," and depth == 1:
            parts.append(text[begin:i])
            begin = i + 1
        i += 1
    raise FormatError(f"unbalanced braces in {text!r}")


def _range(body: str) -> list[str] | None:
    """The values of ``a..b`` or ``a..b..step``, None if it is no range."""
    m = re.fullmatch(r"(-?\d+)\.\.(-?\d+)(?:\.\.(-?\d+))?", body)
    if m:
        lo, hi, step = int(m[1]), int(m[2]), abs(int(m[3] or 1)) or 1
        padded = any(re.match(r"-?0\d", x) for x in (m[1], m[2]))
        width = max(len(m[1]), len(m[2])) if padded else 0
        values = range(lo, hi + 1, step) if lo <= hi else range(lo, hi - 1, -step)
        return [f"{v:0{width}d}" for v in values]
    m = re.fullmatch(r"([A-Za-z])\.\.([A-Za-z])(?:\.\.(-?\d+))?", body)
    if m:
        lo, hi, step = ord(m[1]), ord(m[2]), abs(int(m[3] or 1)) or 1
        return [chr(v) for v in (range(lo, hi + 1, step) if lo <= hi else range(lo, hi - 1, -step))]
    return None


def brace_expand(pattern: str) -> list[str]:
    """Shell-like alternatives and ranges; ``{x}`` without a comma or range stays."""
    out, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out = [x + pattern[i + 1] for x in out]
            i += 2
        elif c == "{":
            parts, i = _parse_group(pattern, i + 1)
            if len(parts) == 1:
                made = _range(parts[0])
                if made is None:
                    made = ["{" + x + "}" for x in brace_expand(parts[0])]
            else:
                made = [x for p in parts for x in brace_expand(p)]
            out = [a + b for a in out for b in made]
        elif c == "}":
            raise FormatError(f"unbalanced braces in {pattern!r}")
        else:
            out = [x + c for x in out]
            i += 1
    return out


def brace_expand_all(patterns: Iterable[str]) -> list[str]:
    return [x for p in patterns for x in brace_expand(p)]


def env_subst(text: str, env: dict[str, str] | None = None) -> str:
    """Replaces ${NAME} by the prefixed variable, again and again up to ten times."""
    env = dict(os.environ) if env is None else env

    def one(m: re.Match) -> str:
        if ENV_PREFIX + m[1] not in env:
            raise MissingKey(f"{ENV_PREFIX}{m[1]} is not set")
        return env[ENV_PREFIX + m[1]]

    for _ in range(10):
        new = re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, text)
        if new == text:
            break
        text = new
    return text


def expand_urls(patterns: str | Iterable[str], env: dict[str, str] | None = None) -> list[str]:
    """``::`` parts, then variables, then braces; order is kept."""
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    return [x for p in patterns for part in p.split("::") for x in brace_expand(env_subst(part, env))]


def format_shard_pattern(pattern: str, n: int) -> str:
    """printf with %d or %i (flags and width), and %%; one conversion is needed."""
    found = 0

    def one(m: re.Match) -> str:
        nonlocal found
        if m[0] == "%%":
            return "%"
        if m[2] not in ("d", "i"):
            raise FormatError(f"bad conversion {m[0]!r} in {pattern!r}")
        found += 1
        return ("%" + m[1] + "d") % n

    out = re.sub(r"%([-+ 0]*\d*)(.|$)", one, pattern)
    if not found:
        raise FormatError(f"{pattern!r} has no place for the shard number")
    return out


def glob_to_regex(pattern: str) -> str:
    """For rlike: anchored; * ? [x] [!x]."""
    return "(?s)^(?:" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + ")$"


# -- seeds ---------------------------------------------------------------------

_MASK = (1 << 64) - 1


def seed_from_str(text: str) -> int:
    """FNV-1a, 64 bits."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & _MASK
    return h


def mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def make_seed(*parts: int) -> int:
    out = 0
    for p in parts:
        out = mix(out ^ mix(p & _MASK))
    return out


def worker_seed(base: str, worker: int = 0) -> int:
    return make_seed(seed_from_str(base), worker)


@dataclass(frozen=True)
class WorkerInfo:
    rank: int = 0
    world_size: int = 1
    worker: int = 0
    num_workers: int = 1


def worker_info(env: dict[str, str] | None = None) -> WorkerInfo:
    """Who reads, from RANK, WORLD_SIZE, WORKER and NUM_WORKERS; alone if they are unset."""
    env = dict(os.environ) if env is None else env
    number = lambda name, default: int(env.get(name) or default)
    out = WorkerInfo(number("RANK", 0), number("WORLD_SIZE", 1), number("WORKER", 0), number("NUM_WORKERS", 1))
    if not (0 <= out.rank < out.world_size and 0 <= out.worker < out.num_workers):
        raise ValueProblem(f"impossible worker {out}")
    return out


def hash_key(seed: int, *parts: Column | int | str) -> Column:
    """The text key that all seeded orders and draws use: md5 of seed and parts joined by colons."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary"))


def hash_mod(key: Column, n: Column | int) -> Column:
    """The first 32 bits of a key, modulo n."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long"))


# -- words for people ------------------------------------------------------------


def human_bytes(n: int) -> str:
    size, units = float(n), ["B", "kB", "MB", "GB", "TB", "PB"]
    while size >= 1000 and len(units) > 1:
        size /= 1000
        units.pop(0)
    return f"{n} B" if units[0] == "B" else f"{size:.1f} {units[0]}"


def shorten(text: str, width: int) -> str:
    return text if len(text) <= width else "..." + text[len(text) - max(0, width - 3) :]


def sample_size(value: object) -> int:
    """Bytes of a value's payload, of a mapping or list those of its parts."""
    if value is None:
        return 0
    if isinstance(value, dict):
        return sum(sample_size(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return sum(sample_size(v) for v in value)
    if isinstance(value, str):
        return len(value.encode())
    return int(value.nbytes) if hasattr(value, "nbytes") else len(value) if isinstance(value, (bytes, bytearray)) else 8


def describe(value: object) -> str:
    """A value in a few words."""
    if isinstance(value, str):
        return f"text {shorten(value, 40)!r}"
    if isinstance(value, (bytes, bytearray)):
        return f"bytes, {human_bytes(len(value))}"
    if hasattr(value, "shape") and hasattr(value, "dtype"):
        return f"tensor {value.dtype} {'x'.join(map(str, value.shape)) or 'scalar'}"
    if isinstance(value, dict):
        return f"map of {len(value)}"
    if isinstance(value, (list, tuple)):
        return f"list of {len(value)}"
    return "null" if value is None else f"{type(value).__name__} {value}"


def identity(x):
    return x


def is_iterable(x: object) -> bool:
    return isinstance(x, Iterable) and not isinstance(x, (str, bytes))


def guess_batchsize(batch: object) -> int:
    """Rows of a batch: of its first column."""
    first = next(iter(batch.values())) if isinstance(batch, dict) else batch[0]
    return len(first)


def choose_weighted(weights: list[float], u: float) -> int:
    """The place of u (0 to 1) among cumulative weights."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueProblem("weights must be zero or more, and not all zero")
    total, seen = sum(weights), 0.0
    for i, w in enumerate(weights):
        seen += w / total
        if u < seen:
            return i
    return max(i for i, w in enumerate(weights) if w > 0)
