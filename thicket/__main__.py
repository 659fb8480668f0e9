"""python -m thicket dataset create|split|info, learn scm|tree."""

from __future__ import annotations

import argparse
import json
import os
import random
import sys
import time
from itertools import product

from . import __version__
from .operators import cart, reports, scm, splits
from .session import session
from .sources import ingest
from .sources.dataset import Dataset
from .sources.formats import blacklist, ids


#: What `dataset info` tells, one flag each; without flags, all but the lists of features and examples.
INFO = ("all", "genome-type", "genomic-data", "genome-ids", "genome-count", "kmers", "kmer-len", "kmer-filter", "kmer-count", "phenotype-description", "phenotype-metadata", "phenotype-tags", "classification-type", "splits", "uuid", "compression")


def importance_grid(words: list[str] | None, tags: list[str]) -> list[list[float] | None]:
    """`a: 1 2 b: 3` gives values by class, `1 2` the same ones for each; all their combinations are tried."""
    if not words:
        return [None]
    if not words[0].endswith(":"):
        words = [w for t in tags for w in (f"{t}:", *words)]
    own: dict[str, list[float]] = {}
    for w in words:
        if w.endswith(":"):
            last = own.setdefault(w[:-1], [])
        else:
            last.append(float(w))
    if set(own) != set(tags) or not all(own.values()):
        raise ValueError(f"each class has importances, no other has: {', '.join(tags)}")
    return [list(x) for x in sorted(set(product(*(own[t] for t in tags))))]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("thicket")
    top.add_argument("--version", action="version", version=f"thicket {__version__}")
    kinds = top.add_subparsers(dest="kind", required=True)
    data = kinds.add_parser("dataset").add_subparsers(dest="action", required=True)
    sources = data.add_parser("create").add_subparsers(dest="source", required=True)
    for name in ("from-tsv", "from-contigs", "from-reads"):
        p = sources.add_parser(name)
        p.add_argument("--genomic-data", required=True)
        p.add_argument("--phenotype-description")
        p.add_argument("--phenotype-metadata")
        p.add_argument("--output", required=True)
        p.add_argument("--compression", default="zstd", choices=["none", "snappy", "gzip", "zstd"])
        if name != "from-tsv":
            p.add_argument("--kmer-size", type=int, default=31)
            p.add_argument("--singleton-kmers", action="store_true", help="keep k-mers of one example")
        if name == "from-reads":
            p.add_argument("--kmer-min-abundance", type=int, default=1)
    p = data.add_parser("split")
    p.add_argument("--dataset", required=True)
    p.add_argument("--id", required=True)
    p.add_argument("--train-size", type=float, default=0.5)
    p.add_argument("--train-ids")
    p.add_argument("--test-ids")
    p.add_argument("--folds", type=int, default=0)
    p.add_argument("--random-seed", type=int)
    p = data.add_parser("info")
    p.add_argument("--dataset", required=True)
    for flag in INFO:
        p.add_argument(f"--{flag}", action="store_true")
    learners = kinds.add_parser("learn").add_subparsers(dest="action", required=True)
    for name in ("scm", "tree"):
        p = learners.add_parser(name)
        p.add_argument("--dataset", required=True)
        p.add_argument("--split", required=True)
        p.add_argument("--kmer-blacklist")
        p.add_argument("--hp-choice", default="cv", choices=["bound", "cv", "none"] if name == "scm" else ["bound", "cv"])
        p.add_argument("--bound-max-genome-size", type=int)
        p.add_argument("--max-equiv-rules", type=int, default=10_000)
        p.add_argument("--random-seed", type=int)
        p.add_argument("--output-dir", default=".")
        p.add_argument("-x", "--progress", action="store_true", help="tell on standard error how far the search is")
        if name == "scm":
            p.add_argument("--model-type", nargs="+", default=["conjunction", "disjunction"], choices=["conjunction", "disjunction"])
            p.add_argument("--p", nargs="+", type=float, default=list(scm.P_GRID))
            p.add_argument("--max-rules", type=int, default=10)
        else:
            p.add_argument("--criterion", nargs="+", default=["gini"], choices=["gini", "crossentropy"])
            p.add_argument("--max-depth", nargs="+", type=int, default=[10])
            p.add_argument("--min-samples-split", nargs="+", type=int, default=[2])
            p.add_argument("--class-importance", nargs="+")
    return top


def create(spark, a) -> None:
    meta = {"compression": a.compression, "genomic_data": a.genomic_data, "description": a.phenotype_description or "", "metadata_source": a.phenotype_metadata or ""}
    if a.source == "from-tsv":
        ingest.from_tsv(spark, a.output, a.genomic_data, a.phenotype_metadata, **meta)
    elif a.source == "from-contigs":
        ingest.from_contigs(spark, a.output, a.genomic_data, a.phenotype_metadata, a.kmer_size, not a.singleton_kmers, **meta)
    else:
        ingest.from_reads(spark, a.output, a.genomic_data, a.phenotype_metadata, a.kmer_size, a.kmer_min_abundance, not a.singleton_kmers, **meta)


def split(spark, a) -> None:
    d = Dataset(spark, a.dataset)
    seed = random.randrange(2**32) if a.random_seed is None else a.random_seed
    names = d.examples()
    if a.id in d.splits():
        raise ValueError(f"there is a split {a.id} already")
    if (a.train_ids is None) != (a.test_ids is None):
        raise ValueError("train and test ids go together")
    if a.train_ids:
        known = {x: i for i, x in enumerate(names)}
        sides = [spark.createDataFrame([(x,) for x in ids(spark, f)], "example_id string") for f in (a.train_ids, a.test_ids)]
        lost = [r.example_id for side in sides for r in splits.located(d.read("examples"), side)[1].collect()]
        if lost:
            raise ValueError(f"not in the dataset: {', '.join(sorted(lost))}")
        made = splits.by_ids(known, *([r.example_id for r in side.collect()] for side in sides), seed, a.folds)
    else:
        made = splits.by_proportion(len(names), a.train_size, seed, a.folds)
    d.save_split(a.id, *made, seed=seed)


def info(spark, a) -> None:
    d = Dataset(spark, a.dataset)
    asked = [f for f in INFO[1:] if getattr(a, f.replace("-", "_"))]
    if a.all or not asked:
        asked = [f for f in INFO[1:] if a.all or f not in ("kmers", "genome-ids")]
    own, told = d.info(), {"genome-type": "source", "genomic-data": "genomic_data", "phenotype-description": "description", "phenotype-metadata": "metadata_source", "classification-type": "classification_type", "kmer-filter": "filter", "genome-count": "examples", "kmer-count": "features", "uuid": "uuid", "compression": "compression"}
    for flag in asked:
        title = told.get(flag, flag).replace("_", " ")
        if flag in told:
            print(f"{title}: {own.get(told[flag], '')}")
        elif flag == "genome-ids":
            print("\n".join(["genome ids:", *d.examples()]))
        elif flag == "phenotype-tags":
            print(f"{title}: {', '.join(d.tags()) if d.has('tags') else ''}")
        elif flag == "kmer-len":
            print(f"{title}: {d.kmer_length}")
        elif flag == "splits":
            print("\n".join(["splits:", *(d.split_text(x) for x in d.splits())]))
        else:
            for i, r in enumerate(d.read("features").select("feature").orderBy("feature").toLocalIterator(), 1):
                print(f">k{i}\n{r.feature}")


def learn(spark, a) -> None:
    began, d = time.time(), Dataset(spark, a.dataset)
    p, tags, names = d.problem(), d.tags(), d.examples()
    train, test, folds = d.split(a.split)
    if a.hp_choice == "cv" and len(set(folds)) < 2:
        raise ValueError("cross-validation needs a split with folds")
    seed = random.randrange(2**32) if a.random_seed is None else a.random_seed
    k = len(p.features.first().feature) if a.kmer_blacklist else 0
    out = blacklist(spark, a.kmer_blacklist, k) if a.kmer_blacklist else None
    common = {"selection": a.hp_choice, "genome_size": a.bound_max_genome_size, "blacklist": out}
    common["progress"] = (lambda share: print(f"{100 * share:.0f} %", file=sys.stderr)) if a.progress else None
    if a.action == "scm":
        if len(tags) != 2:
            raise ValueError("set covering machines learn two classes")
        model, how = scm.learn_scm(p, train, folds, a.model_type, a.p, a.max_rules, most=a.max_equiv_rules, seed=seed, **common)
        cols = scm.columns(p, [r.feature for r in model.rules])
        got = dict(enumerate(model.predict(cols, p.n)))
        shown, own, equal = str(model) or "(no rule)", reports.fasta(model), reports.scm_equivalents(model)
        listed = reports.rules_text(model)
        rules = [{"feature": r.feature, "kind": r.kind, "importance": i, "equivalent": len(e)} for r, i, e in zip(model.rules, model.importances, model.equivalent, strict=True)]
    else:
        root, priors, how = cart.learn_tree(p, train, folds, a.criterion, a.max_depth, a.min_samples_split, importance_grid(a.class_importance, tags), **common)
        got = cart.predict(root, priors, scm.columns(p, cart.tree_features(root)), p.n, [*train, *test])
        alike = cart.equivalents(p, root, priors, how["criterion"], train, a.max_equiv_rules, seed, out)
        own, equal = reports.tree_fasta(root, priors, how["criterion"], alike, tags)
        shown = reports.tree_text(root, priors, tags)
        weight = cart.importances(root, priors, how["criterion"])
        rules = [{"feature": x.feature, "importance": weight[x.feature], "equivalent": len(e), "examples": len(x.rows), "counts": dict(zip(tags, x.counts, strict=True))} for x, e in zip([x for x in root.walk() if not x.leaf], alike, strict=True)]
        listed = "".join(f"{r['feature']}  importance: {r['importance']:.2f}, equivalent rules: {r['equivalent']}, examples: {r['examples']}\n" for r in rules) or "(no rule)\n"
    sides = {"train": train, "test": test}
    metrics = {s: reports.predicted_metrics(got, p.labels, rows, len(tags)) for s, rows in sides.items()}
    sorted_out = {s: {"correct": [names[i] for i in rows if got[i] == p.labels[i]], "errors": [names[i] for i in rows if got[i] != p.labels[i]]} for s, rows in sides.items()}
    settings = {x: y for x, y in vars(a).items() if x not in ("kind", "action")} | {"random_seed": seed}
    text = [f"{a.action} on {a.dataset}, split {d.split_text(a.split)}", f"seconds: {time.time() - began:.1f}", *(f"{x}, {len(rows)} examples: {reports.class_counts(p.labels, rows, tags)}" for x, rows in sides.items()), ""]
    text += ["Model", "-----", shown, "", "Rules", "-----", listed]
    text += ["Chosen", "------", *(f"{x}: {y}" for x, y in sorted(how.items())), ""]
    for s, m in metrics.items():
        text += [f"Metrics, {s}", "-" * (9 + len(s)), *(f"{x}: {y}" for x, y in m.items() if x != "confusion"), reports.confusion_text(m["confusion"], tags)]
    os.makedirs(a.output_dir, exist_ok=True)
    files = {"report.txt": "\n".join(text), "config.json": json.dumps(settings, indent=1, sort_keys=True), "model.fasta": own}
    files["results.json"] = json.dumps({"model": shown, "rules": rules, "chosen": how, "metrics": metrics, "classifications": sorted_out, "classes": tags}, indent=1, sort_keys=True)
    for name, content in (files | {f"model_rule_{i}_equiv.fasta": e for i, e in enumerate(equal, 1)}).items():
        with open(os.path.join(a.output_dir, name), "w") as f:
            f.write(content)


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    run = learn if a.kind == "learn" else {"create": create, "split": split, "info": info}[a.action]
    run(spark or session(), a)


if __name__ == "__main__":
    main()
