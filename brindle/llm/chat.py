"""Chat formatting: heterogeneous records to canonical turns by schema fingerprint, then to a template.

A record is JSON.  Its nested field paths (arrays as []) that any mapping knows are sorted and
hashed; the hash selects a declarative mapping, which lists where roles and texts are.  Fields that
no mapping knows do not change a fingerprint.  New layouts are new entries of MAPPINGS.

The template writes a turn as <|im_start|>role, line feed, text, <|im_end|>, line feed.  Control
strings inside texts are escaped: of "<", n backslashes and "|" one backslash more is made, and one
less when reading back, so that no text can look like a mark and every text comes back as it was.
The loss mask holds the place of each assistant text in the formatted string, without marks.

Defined results: null role or text is empty; a record that is null, no JSON object or of an unknown
layout gives no turns and status `unmapped` with its fingerprint; optional parts that are null or
missing give no turn; ties of turn numbers keep (role, text) order in the query; a conversation's
turns meet in one row, as its digest is one sequence.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

START, END, NL = "<|im_start|>", "<|im_end|>", "<|nl|>"

#: Each mapping: the paths of its layout, then its turns: ("list", array, role path, text path) or
#: ("fields", ((role, path), ...)). Paths ending in ? may be missing. "roles" are a layout's own names
#: of roles and their canonical ones; any other role stays as it is.
MAPPINGS = (
    {"name": "messages", "list": ("messages", "role", "content")},
    {"name": "sharegpt", "list": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant", "chatgpt": "assistant"}},
    {"name": "turns", "list": ("turns", "speaker", "text"), "roles": {"human": "user", "bot": "assistant", "model": "assistant"}},
    {"name": "dialog", "list": ("dialog", "role", "text")},
    {"name": "prompt_completion", "fields": (("system", "system?"), ("user", "prompt"), ("assistant", "completion"))},
    {"name": "prompt_response", "fields": (("system", "system?"), ("user", "prompt"), ("assistant", "response"))},
    {"name": "instruction", "fields": (("system", "system?"), ("user", "instruction"), ("user+", "input?"), ("assistant", "output"))},
    {"name": "question_answer", "fields": (("user", "question"), ("assistant", "answer"))},
    {"name": "nested_data", "list": ("data.messages", "role", "content")},
)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value that lead to a scalar, null or empty container."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, at + "[]") for v in value))
    return {at + "[]" if isinstance(value, list) else at}


def fingerprint(found: set[str], known: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found & known)).encode()).hexdigest()[:16]


def registry(mappings=MAPPINGS) -> tuple[dict[str, dict], set[str]]:
    """{fingerprint: mapping} over all optional parts, and all known paths."""
    sets: list[tuple[set[str], dict]] = []
    for m in mappings:
        if "list" in m:
            a, r, t = m["list"]
            sets += [({f"{a}[].{r}", f"{a}[].{t}"}, m), ({f"{a}[].{t}"}, m), ({f"{a}[]"}, m)]
        else:
            must = {p for _, p in m["fields"] if not p.endswith("?")}
            may = [p[:-1] for _, p in m["fields"] if p.endswith("?")]
            for bits in range(1 << len(may)):
                sets.append((must | {p for i, p in enumerate(may) if bits >> i & 1}, m))
    known = set().union(*(s for s, _ in sets))
    return {fingerprint(s, known): m for s, m in sets}, known


def _reach(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def _str(x) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def turns_of(record, mapping: dict) -> list[tuple[str, str]]:
    roles = mapping.get("roles", {})
    if "list" in mapping:
        a, r, t = mapping["list"]
        return [(roles.get(_str(x.get(r)), _str(x.get(r))), _str(x.get(t))) for x in _reach(record, a) or [] if isinstance(x, dict)]
    out: list[tuple[str, str]] = []
    for role, path in mapping["fields"]:
        v = _reach(record, path.rstrip("?"))
        if path.endswith("?") and v in (None, ""):
            continue
        if role.endswith("+") and out:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + _str(v))
        else:
            out.append((role.rstrip("+"), _str(v)))
    return out


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the places of assistant texts in it (code points)."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", NL) + "\n"
        body = escape(text)
        parts += [head, body, END + "\n"]
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted string."""
    out = []
    for piece in formatted.split(START)[1:]:
        head, _, rest = piece.partition("\n")
        out.append((unescape(head.replace(NL, "\n")), unescape(rest[: -len(END) - 1])))
    return out


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """records with a JSON column -> other columns, layout, fingerprint, formatted, loss_start and loss_end arrays."""
    rest = [c for c in records.columns if c != record]
    table, known = registry()

    def run(batches):
        for batch in batches:
            names, prints, texts, starts, ends = [], [], [], [], []
            for raw in batch.column(batch.schema.get_field_index(record)).to_pylist():
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                mark = fingerprint(paths(value), known) if isinstance(value, dict) else ""
                m = table.get(mark)
                text, mask = render(turns_of(value, m)) if m else ("", [])
                names.append(m["name"] if m else "unmapped")
                prints.append(mark)
                texts.append(text)
                starts.append([a for a, _ in mask])
                ends.append([b for _, b in mask])
            longs = pa.list_(pa.int64())
            cols = [pa.array(names, pa.string()), pa.array(prints, pa.string()), pa.array(texts, pa.string()), pa.array(starts, longs), pa.array(ends, longs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], *cols], names=[*rest, "layout", "fingerprint", "formatted", "loss_start", "loss_end"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name != record)
    return records.mapInArrow(run, f"{kept}, layout string, fingerprint string, formatted string, loss_start array<bigint>, loss_end array<bigint>")


def records_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, record): conversations as records of all the layouts, dealt by conv_id.

    A layout is used where it can hold the conversation: lists hold any, with a layout's own role names
    where all roles are canonical; prompt and answer layouts hold a user and an assistant turn, with a
    system turn that has a text before them or without one, and an instruction is cut at its first blank line.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    group = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t")).withColumn("deal", F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), F.lit(9)))
    at = lambda i, f: F.get("t", F.lit(i))[f]
    system = (F.size("t") == 3) & (at(0, "role") == "system") & (at(0, "content") != "")
    first = F.when(system, F.lit(1)).otherwise(F.lit(0))
    said, answer = F.get("t", first), F.get("t", first + 1)
    pair = ((F.size("t") == 2) | system) & (said["role"] == "user") & (answer["role"] == "assistant")
    ask, reply, rule = said["content"], answer["content"], F.when(system, at(0, "content"))
    known = F.forall("t", lambda x: x["role"].isin("user", "assistant"))
    own = lambda x, user, bot: F.when(x["role"] == "user", F.lit(user)).when(x["role"] == "assistant", F.lit(bot)).otherwise(x["role"])
    listed = lambda role, text, user="user", bot="assistant": F.transform("t", lambda x: F.struct(own(x, user, bot).alias(role), x["content"].alias(text)))
    json_of = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    cut = F.instr(ask, "\n\n")
    parts = (cut > 0) & (F.length(ask) > cut + 1)
    instruction, extra = F.when(parts, F.substr(ask, F.lit(1), cut - 1)).otherwise(ask), F.when(parts, F.substr(ask, cut + 2))
    deal = F.col("deal")
    record = (
        F.when(pair & (deal == 1), json_of(system=rule, prompt=ask, completion=reply))
        .when(pair & (deal == 2), json_of(system=rule, instruction=instruction, input=extra, output=reply))
        .when(pair & ~system & (deal == 3), json_of(question=ask, answer=reply))
        .when(pair & (deal == 4), json_of(system=rule, prompt=ask, response=reply))
        .when(known & (deal.isin(1, 5)), json_of(conversations=listed("from", "value", "human", "gpt")))
        .when(known & (deal.isin(2, 6)), json_of(turns=listed("speaker", "text", "human", "bot")))
        .when(deal.isin(3, 7), json_of(dialog=listed("role", "text")))
        .when(deal == 8, json_of(data=F.struct(listed("role", "content").alias("messages"))))
        .otherwise(json_of(messages=listed("role", "content")))
    )
    return group.select("conv_id", record.alias("record"))


def _digest(batches):
    """The query's columns, from the formatted strings alone."""
    for batch in batches:
        col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        rows = []
        for text, starts, ends in zip(col("formatted"), col("loss_start"), col("loss_end"), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
            rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("conv_id")), *cols], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op1_schema_fingerprint_chat(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    formatted = format_records(records_of(turns.unionByName(probe)))
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
