"""Named batches of a stored table, each published as a whole.

A batch is a folder with any number of Parquet tables. It counts from the moment a small
commit file with the folder's name appears under the batch's name, by a rename; a writer
that was killed before left a folder that nobody reads. A batch that is published again
replaces its own commit. The commits are one short file per batch, read on the driver.
"""

import json
import uuid

import pyarrow.fs

from newsmill.sources.ledger import opened

COMMITS = "_commits"


def new_folder(path):
    """A folder of its own for the tables of one write."""
    return f"{path}/data/{uuid.uuid4().hex}"


def commit(path, batch, folder, **facts):
    """Publish a folder under the batch's name, with a few facts about it."""
    where, base = opened(path)
    where.create_dir(f"{base}/{COMMITS}", recursive=True)
    unnamed = f"{base}/{COMMITS}/.{uuid.uuid4().hex}"
    with where.open_output_stream(unnamed) as out:
        out.write(json.dumps({"batch": str(batch), "folder": folder.removeprefix(f"{path}/"), **facts}).encode())
    where.move(unnamed, f"{base}/{COMMITS}/{batch}.json")


def committed(path, without=None):
    """{batch: its commit}, but for one batch, in order of the batches' names."""
    where, base = opened(path)
    files = where.get_file_info(pyarrow.fs.FileSelector(f"{base}/{COMMITS}", allow_not_found=True))
    found = {}
    for f in files:
        if f.extension == "json" and not f.base_name.startswith("."):
            with where.open_input_stream(f.path) as part:
                fact = json.loads(part.read())
            found[fact["batch"]] = fact
    return {k: found[k] for k in sorted(found) if k != str(without)}


def read(spark, path, commits, table, schema):
    """One table of some commits, as one frame; ``path`` + folder + name, where committed."""
    names = [f"{path}/{c['folder']}/{table}" for c in commits.values()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
