"""A search of one question, step after step in plain Python, that whole searches are held against. For questions that name no times."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from reelgraph.functions.text import FLAGS, NO_ENTITY, REVERSED, SEED, SEEN_OFTEN, STOP_WORDS
from reelgraph.models import Models, read_json, words
from reelgraph.operators import kernels as K
from reelgraph.operators.final import picked
from reelgraph.operators.scores import CHANNELS, SHOWN, SPARSE
from reelgraph.settings import Settings

NONE = "UNPARSEABLE"


def letters(question: str) -> list[str]:
    """Option letters of a bracketed list after Options:, and of lines like A. x, B) x or (C) x."""
    import ast

    found, part = [], re.search(r"(?s)\[.*\]", question) if "Options:" in question else None
    try:
        items = ast.literal_eval(part[0]) if part else []
    except (ValueError, SyntaxError):
        items = []
    found += [m[1] for x in items if (m := re.match(r"\s*([A-Z])\s*[.):]", str(x)))] if isinstance(items, list | tuple) else []
    return sorted({*found, *(m[1] for x in question.splitlines() if (m := re.match(r"\(?\s*([A-Z])\s*\)?\s*[.):]\s", x.strip())))})


def listed(question: str) -> dict[str, str]:
    import ast

    part = re.search(r"(?s)\[.*\]", question) if "Options:" in question else None
    try:
        items = ast.literal_eval(part[0]) if part else []
    except (ValueError, SyntaxError):
        items = []
    return {m[1]: m[2].strip() for x in items if (m := re.match(r"(?s)([A-Z])\s*[.):]\s*(.*)$", str(x).strip()))} if isinstance(items, list | tuple) else {}


def letter_of(reply: str, options: list[str]) -> str:
    """The marked letter, else the last capital standing alone; NONE if it is no option."""
    marked, alone = re.search(r"(?i)final answer:\s*([A-Z])", reply or ""), re.findall(r"\b([A-Z])\b", reply or "")
    got = marked[1].upper() if marked else alone[-1] if alone else NONE
    return got if not options or got in options else NONE


def even(n: int, count: int) -> list[int]:
    """count of 0..n-1, evenly spread; all if there are no more."""
    if n <= 0 or count <= 0:
        return []
    return list(range(n)) if n <= count else sorted({int(i) for i in np.linspace(0, n - 1, count)})


def simple(question: str) -> list[str]:
    kept = (w.strip(".,?!;:'\"()[]") for w in question.lower().split())
    return list(dict.fromkeys(w for w in kept if len(w) > 2 and w not in STOP_WORDS))[:5]


def entities(given: list) -> list[str]:
    out: dict[str, str] = {}
    for x in given:
        s = str(x if x is not None else "").strip()
        low = re.sub(r"\s+", " ", s.lower())
        if s and low not in NO_ENTITY and (low.startswith("text:") or re.search(r"\d", s) or any(c.isupper() for c in s) or (len(s) > 1 and re.search("[一-鿿]", s))):
            out.setdefault(low, s)
    return list(out.values())


def clean(given) -> list[str]:
    return list(dict.fromkeys(x for k in given or [] if (x := str(k).strip())))


def pictured(given) -> list[str]:
    return [k for k in clean(given) if not k.lower().startswith("text:")]


@dataclass
class Plan:
    """What to look for: words by option and of the question, a sentence for each option, and the question to ask."""

    words: dict[str, list[str]] = field(default_factory=dict)
    question_words: list[str] = field(default_factory=list)
    sentences: dict[str, str] = field(default_factory=dict)
    general: str = ""
    asked: str = ""


def plan_of(reply: str, question: str) -> Plan:
    """A planner's reply, filled up: every option that is named anywhere has an entry, one without words and
    sentence gets words of its text. A reply that can't be read leaves the question's own words."""
    try:
        told = read_json(reply)
        if not isinstance(told, dict):
            raise ValueError
    except ValueError:
        return Plan({o: [] for o in "ABCD"}, simple(question), {}, "", question)
    keys, said = dict(told.get("option_keywords") or {}), dict(told.get("semantic_queries") or {})
    texts = listed(question) | {m[1]: m[2].strip() for x in question.splitlines() if (m := re.match(r"\(?\s*([A-Z])\s*\)?\s*[.):]\s*(.+)$", x.strip()))}
    options = {*keys, *said, *texts} or set("ABCD")
    out = Plan(general=str(told.get("general_semantic_query") or "").strip(), asked=str(told.get("vlm_query") or "").strip() or question)
    for o in sorted(options):
        s = re.sub(rf"(?i)^if (?:the (?:correct )?)?answer is {re.escape(o)}[, ]\s*", "", str(said.get(o) or "").strip())
        if s.lower().startswith("the video should show"):
            s = s.split(":", 1)[1].strip() if ":" in s else ""
        out.sentences[o] = s
        out.words[o] = list(keys.get(o) or []) or ([] if s else simple(texts[o]) if texts.get(o) else [f"option_{o}"])
    out.question_words = entities(told.get("query_keywords") or [])
    if not out.question_words and not any((told.get("temporal_plan") or {}).values()):
        out.question_words = entities(simple(question))
    return out


@dataclass
class Seen:
    """What one look at a segment gave."""

    node: int
    option: str | None
    texts: dict[str, str]
    scores: dict[str, float]
    said: float
    relevance: float


class Scores:
    """Hybrid scores of texts; word counts run on with every step."""

    def __init__(self, models: Models, plan: Plan):
        self.count = Counter(dict.fromkeys(SEEN_OFTEN, SEED))
        self.models = models
        self.phrases = [w for p in dict.fromkeys([*plan.question_words, *(k for ks in plan.words.values() for k in ks)]) if (w := words(p))]
        asks = [s for s in plan.sentences.values() if s]
        self.asks = models.encode(asks) if asks else None

    def vector(self, tokens: list[str], total: int) -> dict[str, float]:
        return {t: c / len(tokens) * (np.log((1 + total) / (1 + self.count[t])) + 1) for t, c in Counter(tokens).items()}

    def of(self, text: str, source: str) -> float:
        if len((text or "").strip()) < 5:
            return 0.0
        own, total, sparse, dense = words(text), sum(self.count.values()), 0.0, 0.0
        if own:
            a = self.vector(own, total)
            size = np.sqrt(sum(x * x for x in a.values()))
            for p in self.phrases:
                b = self.vector(p, total)
                sparse = max(sparse, sum(x * a.get(t, 0.0) for t, x in b.items()) / (size * np.sqrt(sum(x * x for x in b.values()))))
        if self.asks is not None:
            w = text.split()
            dense = float(np.clip((self.models.encode([" ".join(w[i : i + 50]) for i in range(0, len(w), 50)]) @ self.asks.T).max(), 0, 1))
        k = SPARSE.get(source, 0.5)
        return float(np.clip(k * min(1.0, sparse * 1.3) + (1 - k) * dense, 0, 1))


def line_of(source: str, score: float, text: str, s: int, e: int, fps: float) -> str:
    flat = " ".join(text.split())
    return f"[{s / fps:.1f}-{e / fps:.1f}s] {source.upper()}({score:.2f}): {flat[:SHOWN]}{'...' if len(flat) > SHOWN else ''}"


class Search:
    """One question's search of one video."""

    def __init__(self, video: int, x: np.ndarray, question: str, models: Models, heard: dict[int, str], given: Settings, most_steps: int = 10, budget: int = 32):
        self.video, self.x, self.question, self.models, self.heard, self.set, self.budget = video, x, question, models, heard, given, budget
        self.first, self.last, self.v = K.segments(x, given.threshold, given.least_frames)
        self.i, self.j, _, self.w = K.edges(self.v, (self.first + self.last) / 2)
        self.plan = plan_of(models.plan(question), question)
        ids = {o.strip().upper() for o in [*self.plan.words, *self.plan.sentences]} | set(letters(question))
        self.options = sorted(o for o in ids if re.fullmatch("[A-Z]", o)) or list("ABCD")
        self.flags = {k: bool(re.search(p, question.lower())) for k, p in FLAGS.items()}
        self.steps = max(most_steps or 0, max(1, given.base_steps) + max(0, len(self.options) - given.base_options) * max(0, given.steps_per_option))
        self.visual = {o: self.best(pictured(ks)) for o, ks in self.plan.words.items()}
        every = pictured([*self.plan.question_words, *(k for ks in self.plan.words.values() for k in ks)])
        self.y = self.best(every)
        self.f = K.spread(self.i, self.j, self.w, self.y, np.zeros(len(self.v)))
        self.seen, self.visited, self.more = [], np.zeros(len(self.v), bool), None
        self.scores = Scores(models, self.plan)
        self.captions = self.told() if given.several_routes else {}
        self.semantic = {o: self.matched(s) if s else np.zeros(len(self.v)) for o, s in self.plan.sentences.items()} if self.captions else {}

    def best(self, texts: list[str]) -> np.ndarray:
        return np.clip((self.v @ self.models.encode(texts).T).max(axis=1), 0, 1) if texts else np.zeros(len(self.v))

    def told(self) -> dict[int, str]:
        """Captions of segments by the events of the video's timeline."""
        n, fps = len(self.x), self.set.fps
        many = min(self.set.timeline_frames, n)
        frames = [min(int(i * n / many), n - 1) for i in range(many)]
        end = max((f / fps for f in frames), default=0.0)
        out: dict[int, list[str]] = {}
        for a, z, text in timeline(self.models.timeline(self.video, frames), end) if frames else ():
            for k in np.flatnonzero((a < self.last / fps) & (self.first / fps < z)).tolist():
                out.setdefault(k, []).append(text)
        return {k: " | ".join(x) for k, x in out.items()}

    def matched(self, sentence: str) -> np.ndarray:
        """Similarity of a sentence and the captions, rescaled over all segments."""
        s = np.zeros(len(self.v))
        at = sorted(self.captions)
        s[at] = self.models.encode([self.captions[k] for k in at]) @ self.models.encode([sentence])[0]
        return np.clip(s, 0, 1) if s.max() - s.min() < 1e-8 else (s - s.min()) / (s.max() - s.min())

    def channel(self, option: str) -> np.ndarray:
        a = self.visual.get(option, np.zeros(len(self.v)))
        if not self.semantic:
            return a
        k = self.set.visual_share
        return k * a + (1 - k) * self.semantic.get(option, np.zeros(len(self.v)))

    def nearest(self, keywords: list[str]) -> int:
        s = np.round((self.v @ self.models.encode(keywords).T).max(axis=1), 9)
        return int(np.where(self.visited, 0.0, s).argmax())

    def anchors(self) -> dict[str, int]:
        """Options by their best score, each with the best segment that is left."""
        s = {o: np.round(self.channel(o), 9) for o in ({*self.visual, *self.semantic} if self.semantic else self.visual)}
        out: dict[str, int] = {}
        for o in sorted(s, key=lambda o: (-s[o].max(), o)):
            rank = np.argsort(-s[o], kind="stable")
            out[o] = next((int(k) for k in rank if k not in out.values()), int(rank[0]))
        return out

    def hint(self, option: str | None) -> str:
        p, out = self.plan, [self.plan.asked]
        if p.question_words:
            out.append("Focus Keywords (query): " + ", ".join(clean(p.question_words)[:20]))
        if option:
            if k := clean(p.words.get(option)):
                out.append(f"Focus Keywords (option {option}): " + ", ".join(k[:20]))
            if self.set.several_routes and p.sentences.get(option):
                out.append(f"Focus Semantic Query (option {option}): {p.sentences[option]}")
        elif self.set.several_routes and p.general:
            out.append(f"Focus Semantic Query (general): {p.general}")
        return "\n".join(out).strip()

    def look(self, node: int, option: str | None) -> Seen:
        """One step: ask the model, count the words, score the channels, let belief spread."""
        said = observation(self.models, self.video, K.frames_of(int(self.first[node]), int(self.last[node]), 9), self.hint(option), self.set.model_relevance)
        heard = " ".join(dict.fromkeys(self.heard[f] for f in range(self.first[node], self.last[node] + 1) if f in self.heard))
        texts = {"caption": said["caption"], "ocr": said["ocr"], "asr": heard}
        marked = texts["caption"] + "".join(f" [{m.upper()}] {texts[m]}" for m in ("ocr", "asr") if texts[m])
        self.scores.count.update(words(marked))
        score = {k: self.scores.of(t, k) for k, t in texts.items()}
        rel = max(*score.values(), said["relevance"] if self.set.model_relevance else 0.0)
        self.y = self.y.copy()
        self.y[node], self.visited[node] = rel, True
        self.f = K.spread(self.i, self.j, self.w, self.y, self.f)
        self.more = said["more"] or self.more
        self.seen.append(Seen(node, option, texts, score, said["relevance"], rel))
        return self.seen[-1]

    def patrol(self) -> None:
        """The question's segment, one for each option and what stands in for weak ones, then the most promising."""
        words_ = pictured(self.plan.question_words)
        self.anchor = None
        if words_:
            self.anchor = self.nearest(words_)
        elif self.set.several_routes and self.plan.general and self.captions and (s := self.matched(self.plan.general)).max() > 0:
            self.anchor = int(s.argmax())
        self.own = self.anchors()
        of = {n: o for o, n in self.own.items()}
        self.top = {o: (n, 0.0) for o, n in self.own.items()}
        queue = list(dict.fromkeys([*([self.anchor] if self.anchor is not None else []), *self.own.values()]))
        used = 0

        def tracked(node: int) -> Seen:
            got = self.look(node, of.get(node))
            if node in of and got.relevance > self.top[of[node]][1]:
                self.top[of[node]] = (node, got.relevance)
            return got

        at = 0
        while at < len(queue) and used < self.steps:
            node = queue[at]
            got, used = tracked(node), used + 1
            if node in of and got.relevance < 0.2:
                s = np.where(self.visited, 0.0, np.round(self.channel(of[node]), 9))
                if s.max() > 0 and (spare := int(s.argmax())) not in queue:
                    queue.insert(queue.index(node) + 1, spare)
                    of[spare] = of[node]
            at += 1
        for _ in range(self.steps - used):
            word, self.more = self.more, None
            if word and str(word).lower().startswith("text:"):
                continue  # a step, without anything to look for in pictures
            if word:
                node = self.nearest([str(word)])
            else:
                left = np.where(self.visited, 0.0, np.round(self.f, 9))
                if left.max() <= 0:
                    break
                node = int(left.argmax())
            tracked(node)

    def weak(self) -> str:
        """Why the observations can't be chosen by, or nothing."""
        r = np.array([s.relevance for s in self.seen])
        rules = (("none", not len(r)),) if not len(r) else (("max", r.max() < 0.4), ("mean", r.mean() < 0.2), ("flat", r.max() - r.mean() < self.set.least_gap), ("low", (r < 0.2).mean() > 0.7))
        return next((name for name, holds in rules if holds), "")

    def frame_scores(self) -> np.ndarray | None:
        every = pictured([*self.plan.question_words, *(k for ks in self.plan.words.values() for k in ks)])
        return np.clip((self.x @ self.models.encode(every).T).max(axis=1), 0, 1) if every else None

    def frames_in(self, nodes: list[int], scores: np.ndarray | None) -> list[int]:
        out: set[int] = set()
        for k in dict.fromkeys(nodes):
            a, z = int(self.first[k]), int(self.last[k])
            if z - a + 1 <= 4 or scores is None:
                out.update(K.frames_of(a, z, 4))
            else:
                out.update((a + np.argsort(-np.round(scores[a : z + 1], 9), kind="stable")[:4]).tolist())
        return sorted(out)

    def packed(self, scores: np.ndarray | None) -> tuple[list[int], dict[str, tuple[int, int]]]:
        """Frames in one group for each option, and where the groups lie, from 1 on; then evenly spread ones."""
        share = max(1, self.budget // max(1, len(self.own)))
        out: list[int] = []
        where: dict[str, tuple[int, int]] = {}
        for o in sorted(self.own):
            s = np.round(self.visual.get(o, np.zeros(len(self.v))), 9)
            rank = [int(k) for k in np.argsort(-s, kind="stable") if s[k] > 0]
            group: list[int] = []
            for k in list(dict.fromkeys([self.top[o][0], self.own[o], *rank]))[: max(1, share // 4)]:
                group += [f for f in self.frames_in([k], scores) if f not in group]
            if group := group[:share]:
                where[o] = (len(out) + 1, len(out) + len(group))
                out += group
        more = [f for f in even(len(self.x), self.budget - len(out)) if f not in out] if len(out) < self.budget else []
        if more:
            where[""] = (len(out) + 1, len(out) + len(more))
        return (out + more)[: self.budget], where

    def chosen(self) -> tuple[list[int], dict[str, tuple[int, int]] | None]:
        """Frames of the answer: sure segments first, then spread ones over the graph, and evenly spread frames."""
        scores = self.frame_scores()
        if self.flags["not_correct"]:
            return self.packed(scores)
        sure = [n for n, _ in self.top.values()]
        sure += [self.anchor] if self.anchor is not None and self.anchor not in sure else []
        left = max(8, self.budget // 4) - len(sure)
        rest = [k for k in K.spaced(self.f, self.i, self.j, left + 4) if k not in sure][:left] if left > 0 else []
        bonus = 12 if self.flags["count"] else 8 if self.flags["temporal"] or self.flags["text"] or self.flags["audio"] else 0
        share = min(self.set.least_uniform + bonus, max(self.set.least_uniform, self.budget - 8))
        spread = even(len(self.x), share)
        recalled = self.frames_in([*sure, *rest], scores)
        recalled = recalled[: self.budget - share] if self.budget > share else recalled
        return picked(self.x, spread, recalled, scores, self.budget), None

    def lines(self, frames: list[int], fill: bool) -> dict[int, list[str]]:
        """Evidence by place of a frame: of visited segments at their first frame; fill: at all others, too."""
        best: dict[int, Seen] = {}
        for s in self.seen:
            if s.node not in best or s.relevance > best[s.node].relevance:
                best[s.node] = s
        node = np.searchsorted(self.last, frames)
        out: dict[int, list[str]] = {}

        def show(pos: int, k: int, source: str, score: float, text: str) -> None:
            out.setdefault(pos, []).append(line_of(source, score, text, int(self.first[k]), int(self.last[k]), self.set.fps))

        def top(s: Seen) -> str:
            return max(CHANNELS, key=lambda c: s.scores[c])

        for k, s in best.items():
            c = top(s)
            if s.scores[c] > 0 and s.texts[c].strip() and k in node:
                show(int(np.flatnonzero(node == k)[0]), k, c, s.scores[c], s.texts[c])
        for pos, k in enumerate(node.tolist()) if fill else ():
            if pos in out:
                continue
            got = ("", 0.0, "")
            if k in best and best[k].texts[top(best[k])]:
                got = (top(best[k]), best[k].scores[top(best[k])], best[k].texts[top(best[k])])
            else:
                heard = " ".join(dict.fromkeys(self.heard[f] for f in range(self.first[k], self.last[k] + 1) if f in self.heard))
                for c, t in (("asr", heard), ("caption", self.captions.get(k, ""))):
                    if t and (score := self.scores.of(t, c)) > got[1]:
                        got = (c, score, t)
            if got[2].strip():
                show(pos, k, got[0], got[1] if got[1] > 0 else 0.01, got[2])
        return out

    def solve(self) -> dict:
        self.patrol()
        reason, where = self.weak(), None
        if reason:
            frames = even(len(self.x), self.budget)
        else:
            frames, where = self.chosen()
        told = self.lines(frames, bool(reason)) if self.set.show_evidence else {}
        letter, raw = answered(self.models, self.video, self.question, frames, told, where, self.set.fps)
        steps = [{"node": s.node, "option": s.option, "relevance": s.relevance, **{f"{c}_score": s.scores[c] for c in CHANNELS}, "caption": s.texts["caption"]} for s in self.seen]
        lines = [{"pos": p, "line": x} for p, xs in sorted(told.items()) for x in xs]
        return {"answer": letter, "raw": raw, "frames": frames, "fallback": reason, "options": self.options, "segments": len(self.v), "steps": steps, "lines": lines, "belief": self.f.tolist()}


def timeline(text: str, duration: float) -> list[tuple[float, float, str]]:
    """(start, end, text) of passages [MM:SS-MM:SS]; without any, of lines of ten letters, in equal slots."""
    out = []
    seconds = lambda t: int(t.split(":")[0]) * 60 + int(t.split(":")[1])
    for a, z, said in re.findall(r"(?s)\[(\d{1,2}:\d{2})\s*[-–—]\s*(\d{1,2}:\d{2})\]\s*(.+?)(?=\n\[|\n*\Z)", text or ""):
        start, end = float(seconds(a)), float(seconds(z))
        end = start + 5 if end <= start else end
        if said.strip():
            out.append((start, duration if end > duration + 10 else end, said.strip()))
    rows = (text or "").strip().split("\n")
    for k, row in enumerate(rows) if not out else ():
        said = re.sub(r"^[\d.\-*\s]+", "", row.strip()).strip() if len(row.strip()) >= 10 else ""
        if said:
            out.append((k * duration / len(rows), (k + 1) * duration / len(rows), said))
    return out


def observation(models: Models, video: int, frames: list[int], question: str, with_relevance: bool) -> dict:
    """An observer's reply: relevance in [0, 1] (0 if it isn't asked for, raised a little where the caption has two
    words of the question), caption, text of the pictures, and what else should be looked for. Errors are no evidence."""
    if not frames:
        return {"relevance": 0.0, "caption": "", "ocr": "", "more": "any video content"}
    try:
        told = read_json(models.observe(video, frames, question, with_relevance))
        rel, caption = min(1.0, max(0.0, float(told.get("relevance") or 0))) if with_relevance else 0.0, str(told.get("caption") or "")
        if with_relevance and rel < 0.3 and caption:
            near = [w for w in (x.lower().strip(".,?!") for x in question.split() if len(x) > 3) if w in caption.lower()]
            rel = 0.3 if len(near) >= 2 else rel
        more = told.get("refinement_plan")
        more = more.get("missing_visual_keyword") if isinstance(more, dict) and more.get("needs_more_info") else None
        read = list(dict.fromkeys(t for t in told.get("ocr") or [] if len(t.strip()) > 3))[:30]
        return {"relevance": rel, "caption": caption, "ocr": ", ".join(read), "more": more}
    except (ValueError, AttributeError, TypeError):
        return {"relevance": 0.0, "caption": "", "ocr": "", "more": "retry observation"}


def answered(models: Models, video: int, question: str, frames: list[int], told: dict[int, list[str]], where: dict | None, fps: float) -> tuple[str, str]:
    """(letter, raw text): the model's answer to a prompt with times and evidence of the frames; asked once more, for a
    letter only, where it names no option. No frames, or an error: Error."""
    if not frames:
        return "Error", "no frames"
    wrong = where is not None or any(w in question.lower() for w in REVERSED)
    system = f"You judge statements about a video by its images and the evidence beside them. Name the ONE {'INCORRECT' if wrong else 'CORRECT'} option.\nReply as:\nAnalysis: <reasoning>\nFinal Answer: <ONE LETTER>\nReason: <one sentence>"
    info = "\n".join(f"Image {k + 1}: {f / fps:.1f}s" + "".join(f"\n    (During {x})" for x in told.get(k, ())) for k, f in enumerate(frames))
    options = sorted(o for o in where if o) if where and any(where) else letters(question)
    groups = "".join(f"{'Option ' + o if o else 'Extra context'}: Images {a}-{z}\n" for o, (a, z) in (where or {}).items())
    body = (f"Frame Groups:\n{groups}\n" if groups else "") + f"Frame Information:\n{info}\n\nQuestion: {question}"
    try:
        raw = models.answer(video, frames, body, system)
        got = letter_of(raw, options)
        if got == NONE and options:
            ask = f"Answer with ONLY one option letter.\nAllowed options: {', '.join(options)}\n\n{body}"
            again = models.answer(video, frames, ask, f"Output a single letter only. Allowed options: {', '.join(options)}.")
            if (second := letter_of(again, options)) != NONE:
                got, raw = second, f"{raw}\n\n[RETRY]\n{again}"
        return got, raw
    except Exception as error:
        return "Error", f"model error: {error}"
