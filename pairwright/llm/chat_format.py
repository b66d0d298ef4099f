"""Chat formatting with minimum-cost role repair.

Legal conversations: at most one system turn, first; then user and assistant in turn, user
first, assistant last. A dynamic program over that automaton chooses for every turn whether it
keeps its role, gets another, is merged into the turn before, or is preceded by an empty turn,
at the least total cost; the repaired turns are rendered with a template.

A conversation's turns are streamed in order; only the roles of a conversation (a byte a turn)
and its repaired turns are held.

Cases: turns are ordered by turn (nulls last), then role and text, so repeated rows stand next
to each other and are merged like any two turns of one role; a null or unknown role has to be
relabelled, at a lower cost; a null text is empty; rows with a null conv_id are one
conversation; marks of the template inside a text are split so that they have no meaning; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, shuffle_parts

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: States: nothing yet, or the role of the last turn. For each the roles that may follow.
START, FOLLOWS, FINAL = -1, {-1: (0, 1), 0: (1,), 1: (2,), 2: (1,)}, (2,)
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 2, 3, 4, 1
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
KEPT, MERGED, RELABELED = 0, 1, 2


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES else -1


def _paths() -> dict[int, list[tuple[tuple[int, ...], int]]]:
    """For each state: empty turns that may be inserted (two at most) and the state reached."""
    out = {}
    for s in FOLLOWS:
        found, edge = [((), s)], [((), s)]
        for _ in range(2):
            edge = [((*p, r), r) for p, t in edge for r in FOLLOWS[t] if r != 0]
            found += edge
        out[s] = found
    return out


PATHS = _paths()


def _moves(state: int, role: int) -> list[tuple[int, int, tuple[int, ...], int]]:
    """(cost, next state, inserted roles, action) of every way to take a turn; fixed order."""
    out = []
    unknown = role < 0
    if state >= 0 and (role == state or unknown):
        out.append((MERGE + unknown * RELABEL_UNKNOWN, state, (), MERGED))
    elif state >= 0:
        out.append((MERGE + RELABEL, state, (), MERGED))
    for inserted, at in PATHS[state]:
        for r in FOLLOWS[at]:
            change = 0 if r == role else RELABEL_UNKNOWN if unknown else RELABEL
            out.append((change + INSERT * len(inserted), r, inserted, KEPT if r == role else RELABELED))
    return sorted(out, key=lambda m: (m[0], m[3], len(m[2]), m[1]))


MOVES = {(s, r): _moves(s, r) for s in FOLLOWS for r in (-1, 0, 1, 2)}
STATES = (-1, 0, 1, 2)


def repair(roles: list[int]) -> tuple[int, list[tuple[int, tuple[int, ...], int]], tuple[int, ...]]:
    """Least cost, (role, roles inserted before, action) of every turn, roles inserted last."""
    if not roles:
        return 0, [], ()
    cost: dict[int, int] = {START: 0}
    back: list[dict[int, tuple]] = []
    for role in roles:
        nxt: dict[int, tuple] = {}
        for s in STATES:
            if s in cost:
                for c, t, inserted, action in MOVES[s, role]:
                    if t not in nxt or cost[s] + c < nxt[t][0]:
                        nxt[t] = (cost[s] + c, s, inserted, action)
        back.append(nxt)
        cost = {t: v[0] for t, v in nxt.items()}
    ends = [(c + INSERT * len(p), len(p), s, p) for s, c in cost.items() for p, t in PATHS[s] if t in FINAL]
    total, _, state, tail = min(ends)
    out = []
    for step in reversed(back):
        _, before, inserted, action = step[state]
        out.append((state, inserted, action))
        state = before
    return total, out[::-1], tail


def render(turns: list[tuple[str | None, str | None]], template: str = TEMPLATE) -> dict:
    """Repair and render one conversation, given as (role, text) in order."""
    cost, plan, tail = repair([role_number(r) for r, _ in turns])
    out: list[list] = []
    n = [0, 0, 0]
    for (role, inserted, action), (_, text) in zip(plan, turns, strict=True):
        n[action] += 1
        out += [[r, []] for r in inserted]
        if action != MERGED:
            out.append([role, []])
        out[-1][1].append((text or "").replace("<|", "< |"))
    out += [[r, []] for r in tail]
    inserted = sum(len(p[1]) for p in plan) + len(tail)
    text = "".join(template.format(role=ROLES[r], text="\n".join(parts)) for r, parts in out)
    return {"n_turns": len(turns), "n_out": len(out), "cost": cost, "n_merged": n[MERGED], "n_relabeled": n[RELABELED], "n_inserted": inserted, "rendered": text}


COLUMNS = ("n_turns", "n_out", "cost", "n_merged", "n_relabeled", "n_inserted")
SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", roles string, rendered_sha256 string"


def format_chats(conversations: DataFrame, template: str = TEMPLATE, keep_text: bool = False) -> DataFrame:
    """One row for each conversation: counts, cost, SHA-256 of the rendered text[, rendered]."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = shuffle_parts(conversations.sparkSession)
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    names = ["conv_id", *COLUMNS, "roles", "rendered_sha256", *(["rendered"] if keep_text else [])]
    kinds = [pa.int64()] * 7 + [pa.string()] * (2 + keep_text)

    def run(batches):
        out, current, turns = [], None, []

        def close():
            r = render(turns, template)
            roles = "".join(ROLES[i][0] if i >= 0 else "?" for i in (role_number(x) for x, _ in turns))
            out.append((current[0], *(r[c] for c in COLUMNS), roles, hashlib.sha256(r["rendered"].encode()).hexdigest(), *([r["rendered"]] if keep_text else [])))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if current is None or conv != current[0]:
                    if current is not None:
                        close()
                        if len(out) >= 2000:
                            yield batch()
                            out = []
                    current, turns = (conv,), []
                turns.append((role, text))
        if current is not None:
            close()
        if out:
            yield batch()

    return rows.mapInArrow(lean(run), SCHEMA + ", rendered string" * keep_text)
