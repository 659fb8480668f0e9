"""Text, JSON and FASTA of learnt models."""

from __future__ import annotations

import json

from .cart import Node, Priors, importances
from .scm import Model


def tree_text(x: Node, priors: Priors, tags: list[str] | None = None, depth: int = 0) -> str:
    """Sideways, the branch without the feature on top; leaves with their classes' counts and shares."""
    pad = "    " * depth
    if x.leaf:
        c = priors.predicted(x)
        return f"{pad}-> {tags[c] if tags else c} {counts_text(x, priors, tags)}\n"
    return tree_text(x.right, priors, tags, depth + 1) + f"{pad}{x.feature}?\n" + tree_text(x.left, priors, tags, depth + 1)


def counts_text(x: Node, priors: Priors, tags: list[str] | None) -> str:
    """How many examples of each class a node has, and p(c|t)."""
    return ", ".join(f"{tags[c] if tags else c}: {n} ({p:.3f})" for c, (n, p) in enumerate(zip(x.counts, priors.given(x), strict=True)))


def class_counts(labels: list[int], rows: list[int], tags: list[str]) -> str:
    """How many rows of a side are in each class."""
    return ", ".join(f"{t}: {sum(labels[i] == c for i in rows)}" for c, t in enumerate(tags))


def rules_text(model: Model) -> str:
    """Rules with their importance and the number of rules that are as good."""
    equal = [len(e) for e in model.equivalent] + [0] * (len(model.rules) - len(model.equivalent))
    return "".join(f"{r}  importance: {i:.2f}, equivalent rules: {n}\n" for r, i, n in zip(model.rules, model.importances, equal, strict=True)) or "(no rule)\n"


def scm_json(model: Model, metrics: dict, settings: dict) -> str:
    rules = [{"feature": r.feature, "kind": r.kind, "importance": i} for r, i in zip(model.rules, model.importances, strict=False)]
    return json.dumps({"model": str(model), "type": model.type, "rules": rules, "metrics": metrics, "settings": settings}, indent=1, sort_keys=True)


def scm_text(model: Model, metrics: dict, settings: dict) -> str:
    lines = ["Model", "-----", str(model) or "(no rule)", "", "Rules", "-----", rules_text(model), "Settings", "--------"]
    lines += [f"{k}: {v}" for k, v in sorted(settings.items())] + ["", "Metrics", "-------"] + [f"{k}: {v}" for k, v in sorted(metrics.items())]
    return "\n".join(lines) + "\n"


def fasta(model: Model) -> str:
    return "".join(f">rule-{i} {r.kind}, importance: {imp:.2f}\n{r.feature}\n" for i, (r, imp) in enumerate(zip(model.rules, model.importances, strict=False), 1))


def predicted_metrics(got: dict[int, int], labels: list[int], rows: list[int], classes: int) -> dict:
    """Risk, the table of counts by class and predicted class, and for two classes the ratios; -infinity where there is nothing to divide by."""
    table = [[0] * classes for _ in range(classes)]
    for i in rows:
        table[labels[i]][got[i]] += 1
    out = {"risk": sum(got[i] != labels[i] for i in rows) / len(rows) if rows else float("-inf"), "confusion": table}
    if classes == 2:
        (tn, fp), (fn, tp) = table
        ratio = lambda a, b: a / b if b else float("-inf")
        out |= {"tp": tp, "fp": fp, "tn": tn, "fn": fn, "precision": ratio(tp, tp + fp), "sensitivity": ratio(tp, tp + fn), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn) if tp else float("-inf")}
    return out


def confusion_text(table: list[list[int]], tags: list[str]) -> str:
    """Rows are classes, columns predicted classes."""
    cells = [["", *tags], *([t, *map(str, row)] for t, row in zip(tags, table, strict=True))]
    wide = [max(len(r[c]) for r in cells) for c in range(len(tags) + 1)]
    return "".join("  ".join(x.rjust(w) for x, w in zip(r, wide, strict=True)) + "\n" for r in cells)


def tree_fasta(root: Node, priors: Priors, criterion: str, equivalent: list[list[str]], tags: list[str] | None = None) -> tuple[str, list[str]]:
    """The tree's features under their nodes' numbers, those of the children, counts by class and importance; and for each the features that are as good."""
    weight, every = importances(root, priors, criterion), root.walk()
    number = {id(x): i for i, x in enumerate(every)}
    inner = [x for x in every if not x.leaf]
    name = lambda x: f"{'leaf' if x.leaf else 'rule'}-{number[id(x)]}"
    own = "".join(
        f">{name(x)} left: {name(x.left)}, right: {name(x.right)}, examples: {len(x.rows)}, classes: {counts_text(x, priors, tags)}, equivalent: {len(e)}, importance: {weight[x.feature]:.2f}\n{x.feature}\n"
        for x, e in zip(inner, equivalent, strict=True)
    )
    return own, ["".join(f">{name(x)}-equiv-{k}\n{f}\n" for k, f in enumerate(e, 1)) for x, e in zip(inner, equivalent, strict=True)]


def scm_equivalents(model: Model) -> list[str]:
    return ["".join(f">rule-{i}-equiv-{k} {r.kind}\n{r.feature}\n" for k, r in enumerate(e, 1)) for i, e in enumerate(model.equivalent, 1)]
