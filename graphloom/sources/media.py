"""Media values of records: ``@file:``, ``@base64:`` and ``@uri:``, and the content-addressed blobs they become.

Bytes are read, hashed and stored by the tasks that hold the records; a blob's name is its SHA-256, so storing it twice
does no harm and a lost task can run again.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import mimetypes
import os
import uuid
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.errors import LoadError, StorageError
from graphloom.plans.schema import NodeType

PREFIX = "blob://sha256/"
#: How files of these kinds begin.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"%PDF-", "application/pdf"),
    (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"),
)


def sniff(data: bytes) -> str | None:
    for start, mime in SIGNATURES:
        if data.startswith(start):
            return mime
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "audio/wav"
    if data[4:8] == b"ftyp":
        return "video/mp4"
    return None


def choose(hint: str | None, found: str | None, name: str | None) -> str:
    """A given kind must not contradict the bytes; without one, bytes go before the file's name."""
    hint = (hint or "").strip() or None
    if hint and found and hint != found:
        raise LoadError(f"media type {hint} doesn't match {found}")
    mime = hint or found or (mimetypes.guess_type(name)[0] if name else None)
    if mime is None:
        raise LoadError("the media type can't be told; give it")
    return mime


def store(root: str, data: bytes) -> str:
    """Keep bytes once under their hash, in the graph's own folder on whatever file system it lies."""
    digest = hashlib.sha256(data).hexdigest()
    files, base = system(root)
    at = f"{base}/{digest}"
    if files.get_file_info(at).type == fs.FileType.NotFound:
        files.create_dir(base, recursive=True)
        tmp = f"{at}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(tmp) as f:
            f.write(data)
        files.move(tmp, at)
    return PREFIX + digest


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def resolve(root: str, base: str | None, value: str, hint: str | None) -> tuple[str, str]:
    """(uri, mime) of a media value."""
    kind, _, rest = value.partition(":")
    if kind == "@file":
        path = rest if os.path.isabs(rest) or "://" in rest else os.path.join(base, rest) if base else None
        if path is None:
            raise LoadError(f"{value}: a relative path needs a source file")
        try:
            files, at = system(path)
            with files.open_input_stream(at) as f:
                data = f.read()
        except OSError as e:
            raise LoadError(f"{value}: {e}") from None
        return store(root, data), choose(hint, sniff(data), path)
    if kind == "@base64":
        try:
            data = base64.b64decode(rest, validate=True)
        except binascii.Error:
            raise LoadError("broken base64") from None
        return store(root, data), choose(hint, sniff(data), None)
    if kind == "@uri":
        uri = rest.strip()
        if not uri:
            raise LoadError("a media URI can't be empty")
        url = urlparse(uri)
        if url.scheme == "file" and not (hint or "").strip():
            with open(unquote(url.path), "rb") as f:
                return uri, choose(None, sniff(f.read(64)), url.path)
        return uri, choose(hint, None, url.path)
    raise LoadError("media must be @file:, @base64: or @uri:")


def import_media(df: DataFrame, t: NodeType, db: str, base: str | None) -> DataFrame:
    """Replace media values by their URIs and fill their kinds; LoadError names the first that fail."""
    result = StructType([StructField(c, StringType()) for c in ("uri", "mime", "error")])
    root = f"{db}/blobs"

    @F.arrow_udf(result)
    def take(values: pa.Array, hints: pa.Array) -> pa.Array:
        out = []
        for v, h in zip(values.to_pylist(), hints.to_pylist(), strict=True):
            try:
                uri, mime = resolve(root, base, v, h) if v is not None else (None, h)
                out.append({"uri": uri, "mime": mime, "error": None})
            except LoadError as e:
                out.append({"uri": None, "mime": None, "error": str(e)})
        return pa.array(out, pa.struct([(c, pa.string()) for c in ("uri", "mime", "error")]))

    for p in t.props.values():
        if p.media:
            got = df.withColumn("_media", take.asNondeterministic()(p.name, p.media))
            bad = got.filter("_media.error is not null").select("_media.error").take(1)
            if bad:
                raise LoadError(f"{t.name}.{p.name}: {bad[0][0]}")
            df = got.withColumns({p.name: F.col("_media.uri"), p.media: F.col("_media.mime")}).drop("_media")
    return df


def read_blob(db: str, uri: str) -> bytes:
    if not uri.startswith(PREFIX):
        raise StorageError(f"{uri} is no stored blob")
    files, at = system(f"{db}/blobs/{uri[len(PREFIX) :]}")
    with files.open_input_stream(at) as f:
        return f.read()
