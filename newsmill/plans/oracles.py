"""Read the comparison SQL: blocks headed ``-- name: key``; ``-- part: x`` blocks
are shared pieces, put in where a query says ``{{x}}``."""

import glob
import re


def load(folder):
    parts, found = {}, {}
    for path in sorted(glob.glob(f"{folder}/*.sql")):
        with open(path, encoding="utf-8") as f:
            blocks = re.split(r"(?m)^-- (name|part): (\w+)[ \t]*\n", f.read())[1:]
        for kind, key, text in zip(blocks[::3], blocks[1::3], blocks[2::3]):
            (found if kind == "name" else parts)[key] = text.strip().rstrip(";")

    def fill(text):
        while "{{" in text:
            text = re.sub(r"\{\{(\w+)\}\}", lambda m: parts[m[1]], text)
        return text

    return {key: fill(text) for key, text in found.items()}
