"""The call graph of Go sources: who calls whom, which types have the methods of which interfaces, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorlake.common import keep, release, ship
from anchorlake.functions import symbols as S
from anchorlake.operators.sources import texts
from anchorlake.operators.status import informed

#: A call through an interface counts if so many methods at most can be meant; interfaces embed each other so deep at most.
FAN_OUT, ROUNDS = 5, 5
_UNIT = "file string, dir string, package string, sort string, name string, caller string, qualifier string, path string"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per declaration, call, interface, method and embedded interface (``sort``) of each Go file."""
    names = [x.split()[0] for x in _UNIT.split(", ")]
    for b in batches:
        for k in range(0, b.num_rows, 512):
            part, out = b.slice(k, 512), []
            for file, text in zip(part["file"].to_pylist(), part["text"].to_pylist()):
                package, imports, declared, calls, interfaces = S.go_file(text)
                at = (file, file.rsplit("/", 1)[0] if "/" in file else ".", package)
                out.append((*at, "file", None, None, None, None))
                out.extend((*at, "decl", d, None, None, None) for d in declared)
                out.extend((*at, "call", n, c, q, imports.get(q) if q else None) for c, q, n in calls)
                for name, methods, embedded in interfaces:
                    out.append((*at, "interface", name, None, None, None))
                    out.extend((*at, "method", m, name, None, None) for m in methods)
                    out.extend((*at, "embed", n, name, q, imports.get(q) if q else None) for q, n in embedded)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=names)


def units(files: DataFrame) -> DataFrame:
    """What :func:`resolve` needs of all Go files, one row per thing found."""
    ship(files.sparkSession)
    return texts(files).where("lang = 'go'").select("file", "text").mapInArrow(_units, _UNIT)


def _folder(path: Column, module: str) -> Column:
    """The folder of the module that an import's path means; null for other modules."""
    return F.when(path == module, F.lit(".")).when(path.startswith(module + "/"), F.substring(path, F.lit(len(module) + 2), F.length(path)))


def _sites(u: DataFrame) -> DataFrame:
    """``dir, package, name``: the file that declares a name, null if several do."""
    d = u.where("sort = 'decl'")
    return d.groupBy("dir", "package", "name").agg(F.countDistinct("file").alias("_k"), F.min("file").alias("_f")).select("dir", "package", "name", F.when(F.col("_k") == 1, F.col("_f")).alias("site"))


def interfaces(u: DataFrame, module: str) -> DataFrame:
    """``dir, package, name, file, method``: all methods of the interfaces that can be told, those of embedded ones included.

    Left out are interfaces that are declared twice in their package, have no methods, or embed what is no interface of the
    module (or do so through others, or in a circle, or deeper than ``ROUNDS``).
    """
    key = ["dir", "package", "name"]
    one = u.where("sort = 'interface'").groupBy(*key).agg(F.count("*").alias("_k"), F.min("file").alias("file")).where("_k = 1").drop("_k")
    # A folder's package that others can import: the only one with a file that is no test.
    can = u.where("sort = 'file' AND NOT endswith(file, '_test.go')").groupBy("dir").agg(F.countDistinct("package").alias("_k"), F.min("package").alias("package")).where("_k = 1").drop("_k")
    e = u.where("sort = 'embed'").select("dir", "package", F.col("caller").alias("name"), F.col("name").alias("_n"), F.when(F.col("qualifier") == "", F.col("dir")).otherwise(_folder(F.col("path"), module)).alias("_d"), "qualifier")
    e = e.join(can.select(F.col("dir").alias("_d"), F.col("package").alias("_p")), "_d", "left").withColumn("_p", F.when(F.col("qualifier") == "", F.col("package")).otherwise(F.col("_p")))
    there = one.select(F.col("dir").alias("_d"), F.col("package").alias("_p"), F.col("name").alias("_n"), F.lit(True).alias("_there"))
    open_ = keep(e.join(there, ["_d", "_p", "_n"], "left").select(*key, "_d", "_p", "_n", F.coalesce("_there", F.lit(False)).alias("_there")).distinct())
    methods = keep(u.where("sort = 'method'").select("dir", "package", F.col("caller").alias("name"), F.col("name").alias("method")).join(one.select(*key), key, "left_semi").distinct())
    for _ in range(ROUNDS):
        if open_.isEmpty():
            break
        waits = open_.select(F.col("dir").alias("_d"), F.col("package").alias("_p"), F.col("name").alias("_n")).distinct()
        ready = open_.where("_there").join(waits, ["_d", "_p", "_n"], "left_anti")
        got = methods.select(F.col("dir").alias("_d"), F.col("package").alias("_p"), F.col("name").alias("_n"), "method")
        more = keep(methods.unionByName(ready.join(got, ["_d", "_p", "_n"]).select(*key, "method")).distinct())
        rest = keep(open_.join(ready.select(*key, "_d", "_p", "_n"), [*key, "_d", "_p", "_n"], "left_anti"))
        release(methods), release(open_)
        methods, open_ = more, rest
    return methods.join(one, key).join(open_.select(*key).distinct(), key, "left_anti")


def implementations(u: DataFrame, methods: DataFrame) -> DataFrame:
    """``interface, type`` (``file#name``) and the type's ``dir, package, name``: types that have all methods of an interface.

    Relational division from each interface's rarest method, so that a method that very many types have joins only what has the
    rarest one as well. An interface with one method counts only if exactly one type has it.
    """
    i = methods.select(F.concat("file", F.lit("#"), "name").alias("interface"), F.col("dir").alias("_d"), F.col("package").alias("_p"), F.col("name").alias("_n"), "method")
    types = u.where("sort = 'decl' AND contains(name, '.')").select("dir", "package", F.substring_index("name", ".", 1).alias("name"), F.substring_index("name", ".", -1).alias("method")).distinct()
    often = types.groupBy("method").agg(F.count("*").alias("_k"))
    rare = i.join(often, "method", "left").groupBy("interface", "_d", "_p", "_n").agg(F.count("*").alias("need"), F.min_by("method", F.struct(F.coalesce("_k", F.lit(0)), "method")).alias("method"))
    near = rare.join(types, "method").where("NOT (_d = dir AND _p = package AND _n = name)").select("interface", "need", "dir", "package", "name")
    have = near.join(i.select("interface", "method"), "interface").join(types, ["dir", "package", "name", "method"]).groupBy("interface", "need", "dir", "package", "name").agg(F.count("*").alias("_have")).where("_have = need")
    found = have.join(_sites(u).where("site IS NOT NULL"), ["dir", "package", "name"]).select("interface", "need", F.concat("site", F.lit("#"), "name").alias("type"), "dir", "package", "name")
    alone = found.groupBy("interface").agg(F.count("*").alias("_k"))
    return found.join(alone, "interface").where("need > 1 OR _k = 1").select("interface", "type", "dir", "package", "name")


def divide(wanted: DataFrame, held: DataFrame, within: str) -> DataFrame:
    """``within, interface, type``: holders (``within, type, method``) that have all of what another one wants (``within, interface, method``).

    The same division inside groups, also begun at the rarest thing wanted. What wants one thing counts only if one has it.
    """
    held = held.select(within, "type", "method").distinct()
    wanted = wanted.select(within, "interface", "method").distinct()
    often = held.groupBy(within, "method").agg(F.count("*").alias("_k"))
    rare = wanted.join(often, [within, "method"], "left").groupBy(within, "interface").agg(F.count("*").alias("need"), F.min_by("method", F.struct(F.coalesce("_k", F.lit(0)), "method")).alias("method"))
    near = rare.join(held, [within, "method"]).select(within, "interface", "need", "type")
    have = near.join(wanted, [within, "interface"]).join(held, [within, "type", "method"]).groupBy(within, "interface", "need", "type").agg(F.count("*").alias("_have")).where("_have = need")
    alone = have.groupBy(within, "interface").agg(F.count("*").alias("_k"))
    return have.join(alone, [within, "interface"]).where("need > 1 OR _k = 1").select(within, "interface", "type")


def edges(u: DataFrame, module: str, methods: DataFrame, impls: DataFrame) -> DataFrame:
    """``src, dst`` (``file#symbol``) of all calls that can be resolved, each once, none to itself.

    A bare name means the caller's own file if it declares it, else the only file of its package that does. A name behind an
    import means the only importable package of a folder of the module, or nothing. A name behind anything else means the
    package's only method of that name, else the methods of types that have an interface with it, if there are at most ``FAN_OUT``.
    """
    key = ["dir", "package", "name"]
    sites = _sites(u)
    own = u.where("sort = 'decl'").select("file", "name", F.lit(True).alias("_own")).distinct()
    calls = u.where("sort = 'call'").select("file", "dir", "package", F.concat("file", F.lit("#"), "caller").alias("src"), "qualifier", "path", "name").distinct()

    def looked_up(c: DataFrame) -> DataFrame:
        got = c.join(sites, key).join(own, ["file", "name"], "left")
        at = F.coalesce("site", F.when(F.col("_own"), F.col("file")))
        return got.where(at.isNotNull()).select("src", F.concat(at, F.lit("#"), "name").alias("dst"))

    bare = looked_up(calls.where("qualifier = ''"))
    can = u.where("sort = 'file' AND NOT endswith(file, '_test.go')").groupBy("dir").agg(F.countDistinct("package").alias("_k"), F.min("package").alias("package")).where("_k = 1").drop("_k")
    far = calls.where("path IS NOT NULL").select("file", "src", "name", _folder(F.col("path"), module).alias("dir")).where("dir IS NOT NULL")
    far = looked_up(far.join(can, "dir"))
    loose = calls.where("qualifier <> '' AND path IS NULL").withColumnRenamed("name", "_base")
    methods_of = u.where("sort = 'decl' AND contains(name, '.')").select("dir", "package", "name", F.substring_index("name", ".", -1).alias("_base")).distinct()
    lone = methods_of.groupBy("dir", "package", "_base").agg(F.count("*").alias("_k"), F.min("name").alias("name")).where("_k = 1").drop("_k")
    near = loose.join(lone, ["dir", "package", "_base"])
    by_name = looked_up(near.select("file", "dir", "package", "src", "name"))
    meant = impls.join(methods.select(F.concat("file", F.lit("#"), "name").alias("interface"), "method").distinct(), "interface").select("dir", "package", F.concat("name", F.lit("."), "method").alias("name"), F.col("method").alias("_base")).distinct()
    targets = meant.join(sites.where("site IS NOT NULL"), key).select("_base", F.concat("site", F.lit("#"), "name").alias("dst")).distinct()
    few = targets.groupBy("_base").agg(F.count("*").alias("_k")).where(F.col("_k") <= FAN_OUT).select("_base")
    through = loose.join(lone.select("dir", "package", "_base"), ["dir", "package", "_base"], "left_anti").join(few, "_base").join(targets, "_base").select("src", "dst")
    return bare.unionByName(far).unionByName(by_name).unionByName(through).where("src <> dst").distinct()


def call_graph(files: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """Calls (``src, dst``) and implementations (``interface, type``) of the Go files of a module."""
    u = keep(units(files))
    methods = keep(interfaces(u, module))
    impls = keep(implementations(u, methods))
    return keep(edges(u, module, methods, impls)), impls.select("interface", "type").distinct()


def impact(calls: DataFrame, changed: DataFrame, entries: DataFrame) -> DataFrame:
    """``node_id, callers, told``: of each changed node how many call it, and which of these have active entries, by id."""
    c = calls.join(changed.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")
    told = informed(entries).select(F.col("node_id").alias("src"), F.lit(True).alias("_t"))
    per = c.join(told, "src", "left").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers"), F.array_sort(F.collect_set(F.when(F.col("_t"), F.col("src")))).alias("told"))
    return per.where(F.size("told") > 0)


def centrality(calls: DataFrame) -> DataFrame:
    """``file, callers``: calls that come from other files."""
    f = lambda c: F.substring_index(c, "#", 1)
    return calls.where(f("src") != f("dst")).groupBy(f("dst").alias("file")).agg(F.count("*").alias("callers"))


def gaps(calls: DataFrame, nodes: DataFrame, entries: DataFrame, least: int = 2, k: int = 5) -> DataFrame:
    """The ``k`` symbols that most nodes call and nobody has described: ``node_id, callers``, from ``least`` callers on."""
    called = calls.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("callers")).where(F.col("callers") >= least)
    open_ = nodes.where("level IN ('function', 'decl') AND status <> 'orphaned'").select("node_id")
    return called.join(open_, "node_id", "left_semi").join(informed(entries), "node_id", "left_anti").orderBy(F.desc("callers"), "node_id").limit(k)


def structure(calls: DataFrame, impls: DataFrame) -> list[tuple[str, DataFrame]]:
    """The four kinds of edges of a call graph for ``graph.neighbours``."""
    back = lambda df, a, b: df.select(F.col(b).alias("src"), F.col(a).alias("dst"))
    return [("calls", calls), ("called by", back(calls, "src", "dst")), ("implemented by", back(impls, "type", "interface")), ("implements", back(impls, "interface", "type"))]
