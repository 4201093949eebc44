"""Chat formatting over schema fingerprints, in DataFrame functions only.

Records of any layout come as variants. The nested field paths below the known top-level keys of a record are hashed
(scalar types left out), and the hash selects a declarative :class:`Layout` that says where its turns are. Turns are
rendered with a template that marks roles, bodies and ends; control strings inside texts get a backslash that
:func:`unescape` takes off again, and the loss mask is a list of code-point spans over the rendered text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
#: What the template, or a common one, could read as markup: a lead, any backslashes, a tail.
_TAIL = r"(\|\w+\|>|/?s>|</?SYS>>|/?INST\])"
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _TAIL, r"([<\[])\\(\\*)" + _TAIL
TURNS = "array<struct<role:string,text:string>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _PLAIN, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, r"$1$2$3")


@dataclass(frozen=True)
class Layout:
    """A layout's name, its shape ({key: None | {..} | [{..}]}) and its turns.

    turns: one (key, role field, text field) for a list of messages, or (role, key) pairs for prompt-like records.
    """

    name: str
    shape: dict
    messages: tuple[str, str, str] | None = None
    pairs: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", {"messages": [{"role": None, "content": None}]}, ("messages", "role", "content")),
    Layout("turns", {"messages": [{"role": None, "text": None}]}, ("messages", "role", "text")),
    Layout("from_value", {"conversations": [{"from": None, "value": None}]}, ("conversations", "from", "value")),
    Layout("prompt_response", {"prompt": None, "response": None}, pairs=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", {"prompt": None, "completion": None}, pairs=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", {"system": None, "prompt": None, "response": None}, pairs=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", {"instruction": None, "output": None}, pairs=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", {"instruction": None, "input": None, "output": None}, pairs=(("user", "instruction+input"), ("assistant", "output"))),
    Layout("question_answer", {"question": None, "answer": None}, pairs=(("user", "question"), ("assistant", "answer"))),
)
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape_text(shape: object) -> str:
    if isinstance(shape, dict):
        return "OBJECT<" + ", ".join(f"{k}{': ' + shape_text(v) if v is not None else ''}" for k, v in sorted(shape.items())) + ">"
    return f"ARRAY<{shape_text(shape[0])}>" if isinstance(shape, list) and shape and shape[0] is not None else "ARRAY<>"


def known_keys(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({k for x in layouts for k in x.shape})


def paths_text(v: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The nested field paths of a variant below the known keys; other keys and scalar types don't count."""
    parts = []
    for k in known_keys(layouts):
        s = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        s = F.regexp_replace(s, r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?", "")
        s = F.regexp_replace(s, r"ARRAY<(?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?>", "ARRAY<>")
        s = F.regexp_replace(s, r"^(?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?$", "")
        parts.append(F.when(s.isNotNull(), F.concat(F.lit(k), F.when(s == "", "").otherwise(F.concat(F.lit(": "), s)))))
    return F.concat(F.lit("OBJECT<"), F.concat_ws(", ", *parts), F.lit(">"))


def fingerprint(v: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    return F.xxhash64(paths_text(v, layouts))


def canonical_turns(v: Column, layout: Layout) -> Column:
    if layout.messages:
        key, role, text = layout.messages
        got = F.try_variant_get(v, f"$.{key}", f"array<struct<{role}:string,{text}:string>>")
        named = F.create_map(*[F.lit(x) for kv in _ROLES.items() for x in kv]) if role == "from" else None

        def turn(m: Column) -> Column:
            r = F.coalesce(m[role], F.lit(""))
            r = F.coalesce(F.try_element_at(named, r), r) if named is not None else r
            return F.struct(r.alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))

        return F.transform(got, turn)
    turns = []
    for role, keys in layout.pairs:
        parts = [F.try_variant_get(v, f"$.{k}", "string") for k in keys.split("+")]
        # an empty second part (an instruction without input) adds no line
        text = F.concat_ws("\n", parts[0], *[F.when(p != "", p) for p in parts[1:]])
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def fits(v: Column, layout: Layout) -> Column:
    """Whether a record has what a layout needs, whatever else it holds."""
    if layout.messages:
        key, role, text = layout.messages
        got = F.try_variant_get(v, f"$.{key}", f"array<struct<{role}:string,{text}:string>>")
        return F.coalesce(F.exists(got, lambda m: m[text].isNotNull()), F.lit(False))
    needs = [F.try_variant_get(v, f"$.{k}", "string").isNotNull() for k in layout.shape]
    out = needs[0]
    for x in needs[1:]:
        out = out & x
    return F.coalesce(out, F.lit(False))


def to_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with a variant ``record`` -> further columns fingerprint, layout and turns.

    A fingerprint that is no layout's (a message holds further fields, or known keys of two layouts meet) falls to the
    first layout, those of more keys before those of fewer, whose fields the record has. Where none fits layout is null
    and turns are empty, so that such records can be counted.
    """
    out = records.withColumn("fingerprint", fingerprint(F.col("record"), layouts))
    layout = turns = None
    exact = [(x, F.col("fingerprint") == F.xxhash64(F.lit(shape_text(x.shape)))) for x in layouts]
    loose = [(x, fits(F.col("record"), x)) for x in sorted(layouts, key=lambda x: (not x.messages, -len(x.shape)))]
    for x, hit in exact + loose:
        name, got = F.lit(x.name), canonical_turns(F.col("record"), x)
        layout = F.when(hit, name) if layout is None else layout.when(hit, name)
        turns = F.when(hit, got) if turns is None else turns.when(hit, got)
    return out.withColumns({"layout": layout, "turns": F.coalesce(turns.cast(TURNS), F.array().cast(TURNS))})


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(END))), "")


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """(start, length) in code points of the rendered text for each body of ``role``."""
    fixed = len(TURN) + len(BODY)

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + fixed + F.length(escape(t["role"]))
        n = F.length(escape(t["text"]))
        spans = F.when(t["role"] == role, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), n.alias("n"))))).otherwise(acc["spans"])
        return F.struct((start + n + len(END)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def parse(formatted: Column) -> Column:
    """The turns of a rendered text."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        two = F.split(p, r"<\|body\|>", 2)
        return F.struct(unescape(F.substring(two[0], len(TURN) + 1, 1 << 30)).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["n"]))), "")


def format_records(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout, turns, formatted and loss_spans to records with a variant ``record``.

    A null record, or one that no layout fits, has a null layout, no turns and an empty text. Null roles and texts become
    empty; repeated rows give repeated results; an empty table gives an empty result. Columns of these names in
    ``records`` are replaced; others pass through.
    """
    out = to_turns(records, layouts)
    return out.withColumns({"formatted": render(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows -> (conv_id, record), turns in order of (turn, role, text), nulls first.

    Rows of null conv_id form one conversation. Repeated rows are repeated turns. Further columns are ignored.
    """
    each = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(each)).alias("m"))
    messages = F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of (conv_id, formatted, loss_spans) finds, and the layout each came from."""
    back = formatted.select("conv_id", "layout", "formatted", parse(F.col("formatted")).alias("back"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


_ESC = r"'([<\[])(\\*)(\|\w+\|>|/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g'"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'turns' AS layout FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', 'prompt_response'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', 'prompt_response')),
g AS (SELECT conv_id, any_value(layout) AS layout, count(*) AS n,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum({len(TURN) + len(BODY) + len(END)} + length(regexp_replace(role, {_ESC})) + length(regexp_replace(text, {_ESC}))) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars, layout FROM g
"""
