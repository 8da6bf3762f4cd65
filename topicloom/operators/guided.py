"""Operators that a language model guides, through an injected client; offline tests pass a fake.

A client has ``complete(prompt) -> str``. Prompts go out from the driver over small tables (topics, sampled
triplets, low-margin documents), replies are parsed tolerantly, and a failed call falls back to a defined
default. Choices come back as DataFrames that are joined to the corpus.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import unverified
from topicloom.operators.coreset import uniform
from topicloom.operators.topics import entropy_anchors


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class CachedClient:
    """Retries a client and remembers replies by a content hash."""

    client: Client
    attempts: int = 3
    wait: Callable[[int], None] = lambda i: None
    memory: dict[str, str] = field(default_factory=dict)

    def complete(self, prompt: str) -> str:
        key = hashlib.sha256(prompt.encode()).hexdigest()
        if key not in self.memory:
            for i in range(self.attempts):
                try:
                    self.memory[key] = self.client.complete(prompt)
                    break
                except Exception:
                    if i + 1 == self.attempts:
                        raise
                    self.wait(i)
        return self.memory[key]


# ---- tolerant parsing -----------------------------------------------------------------------------------


def parse_object(raw: str | None) -> dict:
    """The reply's JSON object: the slice between the outer braces, or nothing."""
    m = re.search(r"\{.*\}", raw or "", re.S)
    try:
        got = json.loads(m.group(0)) if m else {}
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def parse_letters(raw: str | None, n: int, allowed: str = "BC") -> list[str | None]:
    """n answers: from the field ``answers`` or from single letters in the reply; padded or cut to n."""
    got = parse_object(raw).get("answers")
    if not isinstance(got, list):
        got = re.findall(rf"(?<![A-Za-z])([{allowed}])(?![A-Za-z])", raw or "")
    out = [x.strip().upper() if isinstance(x, str) and x.strip().upper() in allowed and len(x.strip()) == 1 else None for x in got[:n]]
    return out + [None] * (n - len(out))


def parse_groups(raw: str | None, ids: Sequence[int]) -> list[list[int]]:
    """Groups of known ids: the first mention wins, what is not mentioned stands alone."""
    got = parse_object(raw).get("groups")
    if not isinstance(got, list):
        got = [[int(x) for x in re.findall(r"-?\d+", g)] for g in re.findall(r"\[([^\[\]]*)\]", raw or "")]
    seen: set[int] = set()
    out = []
    for g in got:
        own = []
        for x in g if isinstance(g, list) else g.get("topics", []) if isinstance(g, dict) else []:
            try:
                x = int(x)
            except (TypeError, ValueError):
                continue
            if x in ids and x not in seen:
                seen.add(x)
                own.append(x)
        if own:
            out.append(own)
    return out + [[x] for x in ids if x not in seen]


def parse_alignment(raw: str | None, rows: int, known: Iterable[int]) -> list[int | None]:
    """For each new topic the known id it continues, or None for a new theme (also if unknown or missing)."""
    got, known = parse_object(raw).get("matches"), set(known)
    out: list[int | None] = [None] * rows
    for m in got if isinstance(got, list) else []:
        try:
            i, g = int(m["new"]), m.get("global")
            if 0 <= i < rows and g is not None and int(g) in known:
                out[i] = int(g)
        except (TypeError, ValueError, KeyError, AttributeError):
            continue
    return out


# ---- labels -----------------------------------------------------------------------------------------------


def keyword_label(keywords: Sequence[str]) -> tuple[str, str]:
    return " & ".join(k.title() for k in keywords[:3]), "Documents about " + ", ".join(keywords[:6])


def label_topics(client: Client, topics: list[dict], style: str = "short", context: int = 40) -> list[dict]:
    """Label and description of each topic (dicts topic_id, keywords, examples), one call each.

    Labels given before (at most ``context`` of the last ones) are in the prompt so that they are not given
    again; a failed or empty reply falls back to the keywords. Colliding labels get a second pass.
    """
    done: list[dict] = []
    for t in topics:
        taken = [d["label"] for d in done][-context:]
        done.append(_label(client, t, style, taken))
    keys: dict[str, int] = {}
    for i, d in enumerate(done):
        key = " ".join(d["label"].lower().split()[:3])
        if key in keys:
            again = _label(client, topics[i], style, [x["label"] for x in done])
            done[i] = again if again["label"].lower() != d["label"].lower() else d | {"label": d["label"] + f" ({topics[i]['keywords'][0] if topics[i]['keywords'] else topics[i]['topic_id']})"}
        keys.setdefault(" ".join(done[i]["label"].lower().split()[:3]), i)
    return done


def _label(client: Client, t: dict, style: str, taken: list[str]) -> dict:
    want = "a name of two to five words" if style == "short" else "a sentence that names the theme"
    prompt = f"Give {want} and a one-line description for a group of documents.\nFrequent terms: {', '.join(t['keywords'][:15])}\nSamples:\n" + "\n".join(f"* {x}" for x in t.get("examples", [])[:5]) + (f"\nNames in use: {'; '.join(taken)}" if taken else "") + '\nReply as JSON with the fields "label" and "description".'
    label, text = keyword_label(t["keywords"])
    try:
        got = parse_object(client.complete(prompt))
    except Exception:
        got = {}
    name = str(got.get("label") or "").strip()
    return {"topic_id": t["topic_id"], "label": name or label, "description": str(got.get("description") or "").strip() or text}


def merge_groups(client: Client, topics: list[dict], instruction: str = "") -> list[list[int]]:
    """Groups of topics that a model finds to be the same theme."""
    prompt = "Which of these topics are one theme? " + instruction + "\n" + "\n".join(f"{t['topic_id']}: {', '.join(t['keywords'][:10])}" for t in topics) + '\nReply as JSON: {"groups": [[ids], ...]}.'
    try:
        raw = client.complete(prompt)
    except Exception:
        raw = None
    return parse_groups(raw, [t["topic_id"] for t in topics])


def align(client: Client, new: list[dict], known: list[dict]) -> list[int | None]:
    """For each new topic the registered one that it continues; nothing is asked of an empty registry."""
    if not known or not new:
        return [None] * len(new)
    side = lambda rows, key: "\n".join(f"{r[key]}: {r.get('label') or ''} | {', '.join(r['keywords'][:10])}" for r in rows)
    prompt = "Match each new topic to the registered topic that it continues, or to null.\nNew:\n" + side([r | {"row": i} for i, r in enumerate(new)], "row") + "\nRegistered:\n" + side(known, "global_id") + '\nReply as JSON: {"matches": [{"new": 0, "global": 3}, ...]}.'
    try:
        raw = client.complete(prompt)
    except Exception:
        raw = None
    return parse_alignment(raw, len(new), [r["global_id"] for r in known])


# ---- triplets -----------------------------------------------------------------------------------------------


def triplet_budget(n: int) -> int:
    """24 (1 + log10(n / 100)), between 24 and 120."""
    return int(min(120, max(24, round(24 * (1 + math.log10(max(n, 1) / 100))))))


def nearest_same_different(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """anchor, positive (nearest with its label) and negative (nearest with another), among neighbours.

    Outliers are neither anchors nor candidates; anchors without both are left out.
    """
    lab = labels.where("topic_id <> -1")
    a, b = lab.select(F.col("doc_id").alias("src"), F.col("topic_id").alias("ta")), lab.select(F.col("doc_id").alias("dst"), F.col("topic_id").alias("tb"))
    j = knn.join(a, "src").join(b, "dst").withColumn("o", F.struct((-F.col("sim")).alias("s"), F.col("dst").alias("d")))
    t = j.groupBy("src").agg(F.min(F.when(F.col("ta") == F.col("tb"), F.col("o"))).alias("p"), F.min(F.when(F.col("ta") != F.col("tb"), F.col("o"))).alias("n"))
    return t.where("p is not null and n is not null").select(F.col("src").alias("anchor"), F.col("p.d").alias("positive"), F.col("n.d").alias("negative"), (F.col("n.s") - F.col("p.s")).alias("margin"))


def hard_margin(triplets: DataFrame, n: int) -> DataFrame:
    """The n triplets with the smallest margin; a tie goes to the smaller anchor."""
    return triplets.orderBy(F.round("margin", 9), "anchor").limit(n)


def sample_triplets(knn: DataFrame | Callable[[DataFrame], DataFrame], labels: DataFrame, n: int, how: str = "fast", probs: DataFrame | None = None, seed: int = 42, fraction: float = 0.5, oversample: int = 4) -> DataFrame:
    """Up to n triplets (anchor, positive, negative, margin) to ask about.

    fast: anchors drawn by seeded hash among documents with a topic. entropy: drawn among the ``fraction`` of them with
    the highest entropy of probs (fast without probs). hard: of ``oversample`` times n fast ones those with the
    smallest margins, ties settled by a seeded jitter under 1e-6. Anchors without both neighbours give none.
    knn: neighbours of all documents, or what finds those of the anchors (column src).
    """
    if how not in ("fast", "entropy", "hard"):
        raise ValueError(how)
    pool = labels.where("topic_id <> -1").select("doc_id")
    if how == "entropy" and probs is not None:
        pool = entropy_anchors(probs.join(pool, "doc_id", "left_semi"), fraction).select("doc_id")
    draw = n * oversample if how == "hard" else n
    anchors = pool.orderBy(uniform("doc_id", seed), "doc_id").limit(draw).select(F.col("doc_id").alias("src"))
    found = nearest_same_different(knn(anchors) if callable(knn) else knn.join(anchors, "src", "left_semi"), labels)
    if how != "hard":
        return found
    return found.orderBy(F.col("margin") + uniform("anchor", seed + 1) * 1e-6, "anchor").limit(n)


def disagreement(partitions: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, minority: in how many runs the less frequent answer to "same community?" is given."""
    x = partitions.select("run", F.col("doc_id").alias("a"), F.col("community").alias("ca"))
    y = partitions.select("run", F.col("doc_id").alias("b"), F.col("community").alias("cb"))
    j = pairs.select("a", "b").join(x, "a").join(y, ["run", "b"]).groupBy("a", "b").agg(F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("same"), F.count(F.lit(1)).alias("runs"))
    return j.select("a", "b", F.least("same", F.col("runs") - F.col("same")).alias("minority"))


def judge(client: Client, triplets: list[dict], seed: int = 42, batch: int = 8, chars: int = 300, cache: dict[str, str | None] | None = None, holdout: float = 0.2) -> list[dict]:
    """Which of two documents is nearer to an anchor: answers B or C (None if unread), with the order swapped
    for about half, a content hash, and a split drawn from it. Cached triplets are not asked again."""
    cache = {} if cache is None else cache
    rng = np.random.default_rng(seed)
    clip = lambda s: s[:chars] + ("..." if len(s) > chars else "")
    rows = []
    for t in triplets:
        swap = bool(rng.random() < 0.5)
        b, c = (t["negative_text"], t["positive_text"]) if swap else (t["positive_text"], t["negative_text"])
        digest = hashlib.sha256("\u0001".join((t["anchor_text"], b, c)).encode()).hexdigest()
        u = int(digest[:13], 16) / 16**13
        rows.append({"anchor": t["anchor"], "positive": t["positive"], "negative": t["negative"], "swapped": swap, "hash": digest, "split": "holdout" if u < holdout else "train", "texts": (clip(t["anchor_text"]), clip(b), clip(c))})
    ask = [r for r in rows if r["hash"] not in cache]
    for lo in range(0, len(ask), batch):
        part = ask[lo : lo + batch]
        prompt = "For each item say which of B and C is nearer in topic to A.\n" + "\n".join(f"{i + 1}. A: {r['texts'][0]}\n   B: {r['texts'][1]}\n   C: {r['texts'][2]}" for i, r in enumerate(part)) + '\nReply as JSON: {"answers": ["B", "C", ...]}.'
        try:
            got = parse_letters(client.complete(prompt), len(part))
        except Exception:
            got = [None] * len(part)
        for r, g in zip(part, got, strict=True):
            cache[r["hash"]] = g
    for r in rows:
        raw = cache.get(r["hash"])
        r["raw_answer"] = raw
        if raw is not None:  # the judged positive, whatever the order shown
            nearer_first = (raw == "B") != r["swapped"]
            r["judged_positive"], r["judged_negative"] = (r["positive"], r["negative"]) if nearer_first else (r["negative"], r["positive"])
        r.pop("texts")
    return rows


def write_judgments(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Append to a JSON-lines cache in any store that Spark writes."""
    if rows:
        spark.createDataFrame([(r["hash"], r["raw_answer"], r["split"]) for r in rows], "hash string, raw_answer string, split string").write.mode("append").json(path)


def read_judgments(spark: SparkSession, path: str) -> dict[str, str | None]:
    return {r["hash"]: r["raw_answer"] for r in spark.read.schema("hash string, raw_answer string, split string").json(path).collect()}


def calibrate(client: Client, partitions_of: Callable[[float, int], DataFrame], triplets_of: Callable[[DataFrame, int], list[dict]], agreement: Callable[[DataFrame, list[dict]], float], coarse: Sequence[float], fine: int = 5, seeds: Sequence[int] = (42, 43, 44)) -> float:
    """The resolution whose partitions agree best with triplets that the client judges.

    partitions_of(resolution, seed), triplets_of(partition, seed): what to ask about (with texts), and agreement of a
    partition with judged triplets. Each seed's triplets come from the middle of the coarse grid and are judged
    once; a score is the mean over seeds. A coarse grid comes first, then a finer one around its best; of equal
    scores the coarse choice stays, else the one nearest the middle.
    """
    middle_of = lambda g: g[len(g) // 2]
    judged, memory = {}, {}
    for s in seeds:
        judged[s] = judge(client, triplets_of(partitions_of(middle_of(coarse), s), s), seed=s, cache=memory)

    def mean(r: float) -> float:
        return sum(agreement(partitions_of(r, s), judged[s]) for s in seeds) / len(seeds)

    score = {r: mean(r) for r in coarse}
    best = max(coarse, key=lambda r: (round(score[r], 9), -abs(r - middle_of(coarse))))
    i = list(coarse).index(best)
    lo, hi = coarse[max(0, i - 1)], coarse[min(len(coarse) - 1, i + 1)]
    grid = np.geomspace(lo, hi, fine).tolist() if lo < hi else [best]
    for r in grid:
        if r not in score:
            score[r] = mean(r)
    top = max(score.values())
    if score[best] >= top - 1e-9:
        return float(best)
    return float(min((r for r in score if score[r] >= top - 1e-9), key=lambda r: abs(r - middle_of(grid))))


def reassign_low_confidence(client: Client, docs: list[dict], topics: dict[int, list[str]], batch: int = 8) -> list[tuple[int, int]]:
    """doc_id and chosen topic for documents (dicts doc_id, text, options); unread choices keep the first."""
    out = []
    for lo in range(0, len(docs), batch):
        part = docs[lo : lo + batch]
        prompt = "Choose the best topic for each text.\n" + "\n".join(f"{i + 1}. {d['text']}\n   " + "; ".join(f"{t}: {', '.join(topics[t][:8])}" for t in d["options"]) for i, d in enumerate(part)) + '\nReply as JSON: {"choices": [ids in order]}.'
        try:
            got = parse_object(client.complete(prompt)).get("choices") or []
        except Exception:
            got = []
        for i, d in enumerate(part):
            try:
                t = int(got[i])
            except (IndexError, TypeError, ValueError):
                t = d["options"][0]
            out.append((d["doc_id"], t if t in d["options"] else d["options"][0]))
    return out


def keyphrases(client: Client, docs: list[dict], n: int = 5, batch: int = 8, chars: int = 300, cache: dict[str, list[str]] | None = None) -> dict[int, list[str]]:
    """doc_id to at most n phrases; cached by content, empty where a reply is unread."""
    cache = {} if cache is None else cache
    key = lambda d: hashlib.sha256(f"{n}\u0001{d['text']}".encode()).hexdigest()
    ask = [d for d in docs if key(d) not in cache]
    for lo in range(0, len(ask), batch):
        part = ask[lo : lo + batch]
        prompt = f"Give up to {n} key phrases for each text.\n" + "\n".join(f"{i + 1}. {d['text'][:chars]}" for i, d in enumerate(part)) + '\nReply as JSON: {"phrases": [[...], ...]}.'
        try:
            got = parse_object(client.complete(prompt)).get("phrases") or []
        except Exception:
            got = []
        for i, d in enumerate(part):
            own = got[i] if i < len(got) and isinstance(got[i], list) else []
            cache[key(d)] = [str(x).strip() for x in own if str(x).strip()][:n]
    return {d["doc_id"]: cache[key(d)] for d in docs}


# ---- themes ---------------------------------------------------------------------------------------------------


def themes(client: Client, topics: list[dict], write: bool = True, chars: int = 1200) -> list[dict]:
    """Report themes over topics (dicts topic_id, size, keywords, label, examples): grouping, then narratives.

    Topics that no group mentions join the largest theme if there is one, else stand alone. Quotations that
    no example contains are listed as unverified.
    """
    by = {t["topic_id"]: t for t in topics}
    prompt = "Group these topics into broader themes with a title each.\n" + "\n".join(f"{t['topic_id']}: {t.get('label') or ', '.join(t['keywords'][:5])} ({t['size']})" for t in topics) + '\nReply as JSON: {"themes": [{"title": "...", "topics": [ids]}, ...]}.'
    try:
        got = parse_object(client.complete(prompt)).get("themes") or []
    except Exception:
        got = []
    out, seen = [], set()
    for g in got:
        ids = list(dict.fromkeys(int(x) for x in g.get("topics", []) if str(x).lstrip("-").isdigit() and int(x) in by and int(x) not in seen)) if isinstance(g, dict) else []
        if ids:
            seen |= set(ids)
            out.append({"title": str(g.get("title") or "").strip() or keyword_label(by[ids[0]]["keywords"])[0], "topic_ids": ids})
    rest = [t["topic_id"] for t in topics if t["topic_id"] not in seen]
    if out and rest:
        max(out, key=lambda o: sum(by[t]["size"] for t in o["topic_ids"]))["topic_ids"] += rest
    elif rest:
        out = [{"title": keyword_label(by[t]["keywords"])[0], "topic_ids": [t]} for t in rest]
    return [_theme(client, o["title"], i + 1, [by[t] for t in o["topic_ids"]], write, chars) for i, o in enumerate(out)]


def _theme(client: Client, title: str, theme_id: int, members: list[dict], write: bool, chars: int) -> dict:
    words = list(OrderedDict.fromkeys(k for t in members for k in t["keywords"]))[:20]
    narrative, shown = "", []
    if write:
        shown = [x[:chars] for t in members for x in t.get("examples", [])[:3]]
        try:
            narrative = client.complete(f"Write a short narrative on the theme {title!r}, quoting only from these texts.\n" + "\n".join(shown)).strip()
        except Exception:
            narrative = f"{title}: {', '.join(words[:6])}."
    return {"title": title, "topic_ids": [t["topic_id"] for t in members], "theme_id": theme_id, "total_size": sum(t["size"] for t in members), "keywords": words, "narrative": narrative, "unverified_quotes": unverified(narrative, shown) if write else []}


def regenerate_theme(client: Client, themes: list[dict], theme_id: int, topics: list[dict], topic_ids: list[int] | None = None, chars: int = 1200) -> list[dict]:
    """The themes with one written anew, over other topics if topic_ids is given (unknown ids are left out).

    KeyError if there is no such theme, ValueError if no topic remains for it.
    """
    by = {t["topic_id"]: t for t in topics}
    old = next((t for t in themes if t["theme_id"] == theme_id), None)
    if old is None:
        raise KeyError(theme_id)
    members = [by[i] for i in dict.fromkeys(old["topic_ids"] if topic_ids is None else topic_ids) if i in by]
    if not members:
        raise ValueError("a theme needs a topic")
    return [_theme(client, t["title"], theme_id, members, True, chars) if t is old else t for t in themes]
