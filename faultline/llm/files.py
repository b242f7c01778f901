"""Files on the shared storage, from the driver or a worker: written under temporary names, then renamed."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs: as the installation offers them) and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def read_bytes(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def publish(uri: str, data: bytes) -> None:
    """Writes under a temporary name and renames: readers see the whole file or none."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(held, compression=None) as f:
        f.write(data)
    store.move(held, path)


def publish_new(uri: str, data: bytes) -> None:
    """``publish`` that fails with FileExistsError if the file is there: of two writers one succeeds.

    Local files by a hard link, others by the Hadoop rename that does not overwrite (atomic on HDFS; an object store must offer it).
    """
    store, path = open_store(uri)
    held = f"{path}.{uuid.uuid4().hex}.tmp"
    if isinstance(store, pafs.LocalFileSystem):
        publish(f"file:{held}", data)
        try:
            os.link(held, path)
        finally:
            os.unlink(held)
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    temporary = f"{uri.rpartition('/')[0]}/{held.rpartition('/')[2]}"
    publish(temporary, data)
    source, target = hadoop.Path(temporary), hadoop.Path(uri)
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    none[0] = hadoop.Options.Rename.NONE
    files = hadoop.FileContext.getFileContext(target.toUri(), conf)
    try:
        files.rename(source, target, none)
    except Exception as failure:
        files.delete(source, False)
        if "FileAlreadyExists" in str(failure):
            raise FileExistsError(uri) from failure
        raise


def settle(store: pafs.FileSystem, held: str, path: str) -> None:
    """Gives a written file its name. Attempts of one task write the same bytes, so the last to settle replaces equal content."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    store.move(held, path)


def remove(uri: str) -> None:
    store, path = open_store(uri)
    kind = store.get_file_info(path).type
    if kind == pafs.FileType.Directory:
        store.delete_dir(path)
    elif kind == pafs.FileType.File:
        store.delete_file(path)


class Manifests:
    """Numbered manifests below a root; the one with the largest number is in force."""

    def __init__(self, root: str):
        self.root = root

    def latest(self) -> tuple[int, dict]:
        store, base = open_store(self.root)
        found = [i.base_name for i in store.get_file_info(pafs.FileSelector(f"{base}/manifests", allow_not_found=True)) if i.base_name.endswith(".json")]
        if not found:
            return 0, {}
        name = max(found)
        return int(name.removesuffix(".json")), json.loads(read_bytes(f"{self.root}/manifests/{name}"))

    def commit(self, version: int, body: dict) -> None:
        """Puts version ``version`` in force if it is the next one; of several that try, one succeeds and the others get RuntimeError."""
        now = self.latest()[0]
        if version != now + 1:
            raise RuntimeError(f"version {now} is in force; {version} can't follow it")
        try:
            publish_new(f"{self.root}/manifests/{version:08d}.json", json.dumps(body, sort_keys=True).encode())
        except FileExistsError:
            raise RuntimeError(f"version {version} has been committed by another writer") from None
