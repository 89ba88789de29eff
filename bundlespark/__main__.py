"""python -m bundlespark COMMAND: the analytic commands over a bundle on disk.

Rows are printed tab-separated, or as JSON lines with --json. Exit status 1: validation
failed or the question cannot be answered.
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bundlespark")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("trust", "sources", "computations", "graph", "concepts", "validate", "index", "log", "show", "id"):
        s = sub.add_parser(name)
        s.add_argument("bundle")
        if name in ("concepts", "validate", "id"):
            s.add_argument("--profile")
        if name == "concepts":
            for flag in ("--type", "--where", "--has", "--missing", "--show"):
                s.add_argument(flag, action="append", default=[])
        if name == "validate":
            for flag in ("--strict", "--profile-enforce", "--log-enforce"):
                s.add_argument(flag, action="store_true")
        if name == "index":
            s.add_argument("--write", action="store_true")
            s.add_argument("--declare-version")
        if name == "log":
            s.add_argument("--check-stale", action="store_true")
            s.add_argument("--since", help="a git revision: concepts changed since then whose log was not")
            s.add_argument("--add", metavar="MESSAGE", help="write an entry to the log beside --concept, or to the root's")
            s.add_argument("--concept")
            s.add_argument("--kind", default="Update")
            s.add_argument("--date", default=datetime.date.today().isoformat())
        if name == "show":
            s.add_argument("concept", nargs="?", help="an id or handle; without it, the menu of concepts")
            s.add_argument("--computation", action="store_true")
            s.add_argument("--sort", choices=("modified", "id"), default="modified")
        if name == "id":
            s.add_argument("prefix", nargs="?", help="the next free handle of this prefix; all handles without it")
            s.add_argument("--key", default="docId")
    for name in ("bundles", "profiles"):
        s = sub.add_parser(name)
        s.add_argument("top", nargs="*", default=None)
        if name == "bundles":
            s.add_argument("--prefixes", action="store_true", help="also the prefixes of the handles that each bundle uses")
    s = sub.add_parser("profile")
    s.add_argument("question", choices=("list", "show", "sources"))
    s.add_argument("name", nargs="?")
    s.add_argument("--registry", action="append", default=[])
    s.add_argument("--top", help="also the descriptors below this folder")
    s.add_argument("--wide", action="store_true")
    s = sub.add_parser("document")
    s.add_argument("profile")
    s.add_argument("--out")
    return p


def main(argv=None) -> int:
    a = _parser().parse_args(argv)
    from .operators import filters
    from .plans import check, docgen, profile, registry

    if a.command == "bundles":
        from .sources import bundle

        roots = sorted({r for t in a.top for r in bundle.discover(t)}) if a.top else bundle.available(os.environ.get("BUNDLE_ROOTS"))
        for r in roots:
            print("\t".join([r, *([", ".join(_prefixes(r))] if a.prefixes else [])]))
        return 0
    if a.command == "profile":
        refs = registry.sources(a.registry, os.environ, local=registry.discover(a.top) if a.top else ())
        entries, failures = registry.survey(refs)
        for f in failures:
            print(f"{f.source}: {f.category}: {f.message}", file=sys.stderr)
        if a.question == "sources":
            print("\n".join(refs))
        elif a.question == "list":
            print("\n".join(registry.table(entries, a.wide)))
        else:
            found = [e for e in entries if a.name in (e.name, e.profile.name)]
            if len(found) != 1:
                print(f"{len(found) or 'no'} profile{'s' * (len(found) != 1)} named {a.name}", file=sys.stderr)
                return 1
            print("\n".join(registry.detail(found[0])))
        return int(bool(failures))
    if a.command == "profiles":
        entries, failures = registry.survey([f for t in a.top or ["."] for f in registry.discover(t)])
        print("\n".join(f"{e.source}\t{e.name}\t{e.profile.name}" for e in entries))
        return int(bool(failures))

    def compiled(path):
        with open(path, encoding="utf-8") as f:
            return profile.compile_profile(profile.load(f.read()))

    if a.command == "document":
        rules = compiled(a.profile)
        for path, text in docgen.render(rules).items() if not a.out else ():
            print(f"== {path}\n{text}")
        for left in docgen.write(rules, a.out) if a.out else ():
            print(f"left as it is: {left}")
        return 0
    rules = compiled(a.profile) if getattr(a, "profile", None) else None
    wanted = []
    if a.command == "concepts":  # a question that cannot match fails before anything is read
        wanted = [*map(filters.of_type, a.type), *map(filters.parse_equals, a.where), *map(filters.present, a.has), *map(filters.absent, a.missing)]
        bad = check_filters(rules, a.type, wanted) if rules else []
        for line in bad:
            print(line, file=sys.stderr)
        if bad:
            return 1
    from pyspark.sql import SparkSession

    from pyspark.sql import functions as F

    from .operators import computations, concepts, graph, handles, index, logs, provenance, show, trust, validate
    from .sources import bundle

    spark = SparkSession.builder.appName("bundlespark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    today, root = datetime.date.today().isoformat(), os.path.abspath(a.bundle)
    c = bundle.read(spark, root)

    def put(df):
        for r in df.toLocalIterator():
            print(_json(r) if a.json else "\t".join("" if x is None else str(x) for x in r))

    if a.command == "trust":
        put(trust.report(c, today))
    elif a.command == "sources":
        put(provenance.report(c))
    elif a.command == "computations":
        put(computations.report(c))
    elif a.command == "graph":
        print(graph.document(c)) if a.json else put(graph.as_json(c))
    elif a.command == "concepts":
        put(filters.where(c, wanted).selectExpr("to_json(fm) as json") if a.json else filters.listing(c, wanted, a.show))
    elif a.command == "index":
        given = (c, bundle.inventory(spark, root), a.declare_version or bundle.declared_version(root), bundle.directories(spark, root))
        bundle.write_index_lines(index.lines(*given), root) if a.write else put(index.render(*given))
    elif a.command == "log":
        found = bundle.read_logs(spark, root)
        if a.add is not None:
            at = logs.path_beside(a.concept)
            if a.concept and concepts.find(c, a.concept).isEmpty():
                print(f"no concept is {a.concept!r}", file=sys.stderr)
            bundle.write_texts(logs.serialize(logs.append(found, at, a.date, a.add, a.kind), bundle.log_titles(spark, root)).where(F.col("log_path") == at).select(F.col("log_path").alias("source_path"), "text"), root)
            print(f"wrote {at} for {a.date}")
        elif a.since:
            try:
                changed = bundle.changed_since(spark, root, a.since)
            except bundle.BundleError as e:
                print(f"not compared with {a.since}: {e}", file=sys.stderr)
                return 0
            put(logs.drift(c, found, changed))
        else:
            put(logs.stale(c, found) if a.check_stale else logs.days(found))
    elif a.command == "show" and not a.concept:
        put(show.menu(c, a.sort))
    elif a.command == "show":
        try:
            print("\n".join(show.computation(c, a.concept, bundle.inventory(spark, root)))) if a.computation else put(show.detail(c, a.concept, today))
        except LookupError as e:
            print(e, file=sys.stderr)
            return 1
    elif a.command == "id":
        key = rules.profile.id_field if rules and rules.profile.id_field else a.key
        if a.prefix and rules and a.prefix not in {t.id_prefix for t in rules.profile.types}:
            print(f"the profile declares no prefix {a.prefix}", file=sys.stderr)
            return 1
        put(handles.next_number(c, key, a.prefix) if a.prefix else handles.in_bundle(c, key))
    elif a.command == "validate":
        version = bundle.declared_version(root)
        found = validate.validate(c, bundle.inventory(spark, root), a.strict, version).cache()
        log_problems = logs.check(bundle.read_logs(spark, root)).cache()
        deviations = check.check(c, rules, strict=a.strict, inventory=bundle.inventory(spark, root)).cache() if rules else None
        for df in filter(None, (found, log_problems, deviations)):
            put(df)
        unmet = check.version_unmet(rules, version) if rules else None
        if unmet:
            print(f"the profile requires version {unmet[0]}, the bundle declares {unmet[1]}")
        if validate.failed(found, log_problems, deviations, profile_enforce=a.profile_enforce, log_enforce=a.log_enforce) or (unmet and a.profile_enforce):
            return 1
        print(f"OK: {c.count()} concepts" + (f", version {version}" if version else ""))
        if deviations is not None and (n := deviations.count()):
            print(f"profile: {n} advisory deviations (--profile-enforce makes them failures)")
        if n := logs.stale(c, bundle.read_logs(spark, root)).count():
            print(f"log: {n} concepts newer than their log (--log-enforce makes days out of order failures)")
    return 0


def _prefixes(root: str) -> list[str]:
    """The prefixes of handles that the bundle at ``root`` uses; none if it can't be read."""
    from pyspark.sql import SparkSession

    from .operators import handles
    from .sources import bundle

    spark = SparkSession.builder.appName("bundlespark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return [r[0] for r in handles.observed_prefixes(bundle.read(spark, root, mode="PERMISSIVE")).collect()]


def check_filters(rules, types, wanted) -> list[str]:
    """What is wrong with filters that cannot match under a profile, a line each."""
    from .plans import profile

    return [f"{code}: {f}" + (f" (one of {', '.join(allowed)})" if allowed else "") for code, f, allowed in profile.check_filters(rules, types, wanted)]


def _json(row) -> str:
    import json

    return json.dumps(row.asDict(True), default=str, ensure_ascii=False)


if __name__ == "__main__":
    sys.exit(main())
