"""A run over strains that goes on where it stopped, and makes anew only what a changed input touches.

A project is a folder. Each stage has a table there, parted by strain and version; what is valid is said by one manifest, which is replaced by a single rename. A stage's version for a strain is a
digest of the stage's parameters and of what it reads: contents of files, or checksums of the rows of other stages. A stage is made for the strains whose version isn't the manifest's, all at once, and
written by overwriting just these partitions; then the manifest names them. So a run that was killed goes on with the first stage that isn't named, readers never see half a stage, and a stage
whose rows come out as they were stops the change from going further: new expression values of one strain reach its expression, the aligned rows, its co-expression edges and its traces, and nothing else.
"""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import graph, hyper
from ..session import stage as timed
from ..sources import annotations
from ..sources.config import Strain
from . import strain as plan

#: The strain under which tables of all strains together are kept.
ALL = "*"


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Files:
    """Small texts in any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.path(name).getFileSystem(self.conf).exists(self.path(name))

    def delete(self, name: str) -> None:
        self.path(name).getFileSystem(self.conf).delete(self.path(name), True)

    def children(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return [s.getPath().getName() for s in self.path(name).getFileSystem(self.conf).listStatus(self.path(name)) if s.isDirectory()]

    def text(self, name: str) -> str:
        stream = self.path(name).getFileSystem(self.conf).open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes beside the file and renames over it: whoever reads sees the old text or the new one."""
        new = self.path(f"{name}.new")
        stream = new.getFileSystem(self.conf).create(new, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.conf).rename(new, self.path(name), options)


class Store:
    """Tables of stages, by strain and version, and the manifest of what is valid: stage -> {schema, strains: {strain: {version, rows}}}."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self._path = f"{self.root}/manifest.json"
        self._known: dict | None = None

    def manifest(self) -> dict:
        """Read once: a project has one writer at a time."""
        if self._known is None:
            self._known = json.loads(self.files.text(self._path)) if self.files.exists(self._path) else {}
        return self._known

    def _replace(self, manifest: dict) -> None:
        self.files.replace(self._path, json.dumps(manifest, indent=1, sort_keys=True))
        self._known = manifest

    def versions(self, stage: str) -> dict[str, str]:
        return {s: x["version"] for s, x in self.manifest().get(stage, {}).get("strains", {}).items()}

    def checksum(self, stage: str, strain: str) -> str:
        """What the stage's rows of a strain are, whenever and however they were made."""
        known = self.manifest().get(stage, {}).get("strains", {})
        return known[strain]["rows"] if strain in known else known.get(ALL, {}).get("rows", "")

    def table(self, stage: str, strains: list[str] | None = None) -> DataFrame:
        """The valid rows of a stage, of all strains or of some."""
        entry = self.manifest().get(stage)
        if entry is None:
            raise ValueError(f"{self.root} has no stage {stage}")
        schema = StructType.fromJson(entry["schema"])
        valid = [f"{s}|{x['version']}" for s, x in entry["strains"].items() if strains is None or s in strains or s == ALL]
        return self._rows(stage, schema, valid)

    def _rows(self, stage: str, schema: StructType, valid: list[str]) -> DataFrame:
        path = f"{self.root}/{stage}"
        if not valid or not self.files.exists(path):
            return self.spark.createDataFrame([], schema)
        kept = [StructField("__strain", StringType()), StructField("__version", StringType())]
        # both are partitions: only the folders of valid versions are read
        rows = self.spark.read.schema(StructType([*schema.fields, *kept])).parquet(path).where(F.concat_ws("|", "__strain", "__version").isin(valid))
        return rows.select(*schema.names)

    def put(self, stage: str, df: DataFrame, versions: dict[str, str]) -> None:
        """Writes df's rows of these strains (the whole of it for ALL), makes them valid, and deletes what they replace."""
        manifest = copy.deepcopy(self.manifest())
        entry = manifest.setdefault(stage, {"strains": {}})
        old = {s: x["version"] for s, x in entry["strains"].items()}
        rows = df.withColumn("__strain", F.lit(ALL) if set(versions) == {ALL} else F.col("strain"))
        named = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])
        rows = rows.withColumn("__version", F.element_at(named, F.col("__strain")))
        path = f"{self.root}/{stage}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__strain", "__version").parquet(path)
        entry["schema"] = df.schema.jsonValue()
        sums = self._checksums(stage, df.schema, versions)
        for s, v in versions.items():
            entry["strains"][s] = {"version": v, "rows": sums.get(s, digest("no rows"))}
        self._replace(manifest)
        for s, v in old.items():
            if s in versions and v != versions[s]:
                self.files.delete(f"{path}/__strain={s}/__version={v}")

    def _checksums(self, stage: str, schema: StructType, versions: dict[str, str]) -> dict[str, str]:
        """Of each strain the number of its rows and two sums over hashes of them, which don't depend on their order."""
        path = f"{self.root}/{stage}"
        if not self.files.exists(path):
            return {}
        kept = [StructField("__strain", StringType()), StructField("__version", StringType())]
        rows = self.spark.read.schema(StructType([*schema.fields, *kept])).parquet(path)
        rows = rows.where(F.concat_ws("|", "__strain", "__version").isin([f"{s}|{v}" for s, v in versions.items()]))
        whole = F.to_json(F.struct(*schema.names))
        sums = rows.groupBy("__strain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(whole).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.concat(F.lit("."), whole))).alias("b"))
        return {r["__strain"]: digest(r["n"], str(r["a"]), r["b"]) for r in sums.collect()}

    def forget(self, stage: str, strains: list[str]) -> None:
        """Strains that are no longer part of the project."""
        manifest = copy.deepcopy(self.manifest())
        for s in strains:
            manifest[stage]["strains"].pop(s, None)
        self._replace(manifest)
        for s in strains:
            self.files.delete(f"{self.root}/{stage}/__strain={s}")


@dataclass(frozen=True)
class Stage:
    """needs are stages or kinds of files (file:<kind>); parameters are whatever else decides on the rows; build gets the run and the strains to make. A whole stage has one table of all strains."""

    name: str
    needs: tuple[str, ...]
    build: Callable[[Run, list[Strain]], DataFrame]
    parameters: Callable[[Strain], object] = lambda s: None
    whole: bool = False


@dataclass
class Run:
    """The settings of a project and what it reads."""

    spark: SparkSession
    root: str
    strains: list[Strain]
    markers: str | None = None
    tables: dict[str, str] = field(default_factory=dict)  # annotation tables by name: Parquet with the strain as a column
    threshold: float = 0.7
    top_k: int = 10
    depth: int = 4
    seconds: dict[str, float] = field(default_factory=dict)
    traced: dict[str, tuple[DataFrame, DataFrame, DataFrame]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)
        self._files: dict[str, str] = {}

    def file_digest(self, path: str) -> str:
        if path not in self._files:
            plain = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            found = plain.select(F.sha2("content", 256).alias("d"), F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("name", "d").collect()  # a file, or the parts of a table
            self._files[path] = digest([r["d"] for r in found])
        return self._files[path]

    def _paths(self, kind: str, s: Strain) -> list[str]:
        if kind == "metabolites":
            return s.metabolite_files
        if kind == "markers":
            return [self.markers] if self.markers else []
        if kind in self.tables:
            return [self.tables[kind]]
        return [s.files[kind]] if kind in s.files else []

    def version(self, stage: Stage, s: Strain) -> str:
        reads = {n: [self.file_digest(p) for p in self._paths(n[5:], s)] if n.startswith("file:") else self.store.checksum(n, s.name) for n in stage.needs}
        return digest(stage.name, stage.parameters(s), reads)

    def layers(self, strains: list[str]) -> plan.Layers:
        t = lambda name: self.store.table(name, strains)
        return plan.Layers(t("genes"), t("rna"), t("rna_replicates"), t("protein"), t("protein_replicates"), t("metabolite"), t("metabolite_replicates"), t("aligned"), t("gene_protein"))

    def annotations(self, strains: list[str]) -> plan.Annotations:
        a = plan.empty_annotations(self.spark)
        for name in ("categories", "pathways", "markers", *ANNOTATIONS):
            setattr(a, name, self.store.table(name, strains))
        a.recovered = self.store.table("recovered", strains).select("accession", "go_id").distinct()
        return a

    def edges(self, strains: list[str]) -> DataFrame:
        return graph.union(*[self.store.table(f"edges_{n}", strains) for n in plan.EDGE_PARTS])

    def members(self, strains: list[str]) -> DataFrame:
        return hyper.union(*[self.store.table(f"members_{n}", strains) for n in plan.MEMBER_PARTS])


#: Annotation tables that come as they are, with their columns.
ANNOTATIONS = {
    "go": "protein_id string, go_id string",
    "protein_ec": "protein_id string, ec string",
    "metabolite_ec": "metabolite_id string, ec string",
    "metabolite_pathway": "metabolite_id string, pathway string",
    "interactions": "protein_a string, protein_b string, combined_score double",
    "recovered": "accession string, go_id string",
}


def _names(strains: list[Strain]) -> list[str]:
    return [s.name for s in strains]


def _given(name: str, columns: str) -> Callable[[Run, list[Strain]], DataFrame]:
    def build(run: Run, strains: list[Strain]) -> DataFrame:
        if name not in run.tables:
            return run.spark.createDataFrame([], f"strain string, {columns}")
        df = run.spark.read.parquet(run.tables[name])
        wanted = [c.split(" ")[0] for c in columns.split(", ")]
        return annotations.required(df, ["strain", *wanted]).select("strain", *wanted).where(F.col("strain").isin(_names(strains)))

    return build


def _markers(run: Run, strains: list[Strain]) -> DataFrame:
    if not run.markers:
        return plan.empty_annotations(run.spark).markers
    return plan.load_markers(run.spark, run.markers).where(F.col("strain").isin(_names(strains)))


def _by_orthologs(column: int) -> Callable[[Run, list[Strain]], DataFrame]:
    """Categories (0) or pathways (1) of each strain's genes by its own file of orthologs."""

    def build(run: Run, strains: list[Strain]) -> DataFrame:
        found = []
        for s in strains:
            if "orthologs" in s.files:
                layers = run.layers([s.name])
                found.append(plan.annotate_by_orthologs(layers, annotations.mapper_annotations(run.spark, s.files["orthologs"]))[column])
        empty = plan.empty_annotations(run.spark)
        return graph.union(*found) if found else (empty.categories, empty.pathways)[column]

    return build


def _edges(name: str) -> Stage:
    part = plan.EDGE_PARTS[name]
    build = lambda run, strains: part.build(run.layers(_names(strains)), run.annotations(_names(strains)), run.threshold, run.top_k)
    return Stage(f"edges_{name}", part.needs, build)


def _members(name: str) -> Stage:
    part = plan.MEMBER_PARTS[name]

    def build(run: Run, strains: list[Strain]) -> DataFrame:
        names = _names(strains)
        return hyper.sized(part.build(run.layers(names), run.annotations(names), run.store.table("edges_clusters", names))).drop("n_nodes")

    return Stage(f"members_{name}", part.needs, build)


_TRACED = ("genes", "rna", "protein", "metabolite", "aligned", "categories", "pathways", "markers", *ANNOTATIONS, *(f"edges_{n}" for n in plan.EDGE_PARTS), *(f"members_{n}" for n in plan.MEMBER_PARTS))


def _traced(place: int) -> Callable[[Run, list[Strain]], DataFrame]:
    """Traces (0), evidence (1) or the determinants' entities (2), which are made together."""

    def build(run: Run, strains: list[Strain]) -> DataFrame:
        names = _names(strains)
        key = digest(names, [run.version(Stage("", _TRACED, build), s) for s in strains])
        if key not in run.traced:
            run.traced = {key: plan.evidence_of(run.layers(names), run.annotations(names), run.edges(names), run.members(names), run.depth)}
        return run.traced[key][place]

    return build


def stages(run: Run) -> list[Stage]:
    """All stages, each after those that it needs."""
    files = lambda s: [s.samples, s.swath]
    deviations = max((s.deviations for s in run.strains), default=0.0)
    correlations = {f"edges_{n}": (run.threshold, run.top_k) for n in ("transcripts", "abundances", "metabolites")}
    out = [
        Stage("genes", ("file:gff",), lambda r, s: plan.read_genes(r.spark, s)),
        Stage("rna_replicates", ("file:expression", "file:counts"), lambda r, s: plan.read_rna(r.spark, s), files),
        Stage("rna", ("rna_replicates",), lambda r, s: plan.rna_means(r.store.table("rna_replicates", _names(s)))),
        Stage("protein_replicates", ("file:proteins",), lambda r, s: plan.read_proteins(r.spark, s), files),
        Stage("protein", ("protein_replicates",), lambda r, s: plan.protein_means(r.store.table("protein_replicates", _names(s)), deviations), lambda s: deviations),
        Stage("metabolite_replicates", ("file:metabolites",), lambda r, s: plan.read_metabolites(r.spark, s), files),
        Stage("metabolite", ("metabolite_replicates",), lambda r, s: plan.metabolite_means(r.store.table("metabolite_replicates", _names(s)))),
        Stage("aligned", ("genes", "rna", "protein"), lambda r, s: plan.align_layers(*(r.store.table(t, _names(s)) for t in ("genes", "rna", "protein")))),
        Stage("gene_protein", ("aligned",), lambda r, s: r.store.table("aligned", _names(s)).select("strain", "gene_id", "protein_id")),
        Stage("categories", ("file:orthologs", "genes"), _by_orthologs(0)),
        Stage("pathways", ("file:orthologs", "genes"), _by_orthologs(1)),
        Stage("markers", ("file:markers",), _markers),
        *[Stage(n, (f"file:{n}",), _given(n, c)) for n, c in ANNOTATIONS.items()],
        *[_edges(n) for n in plan.EDGE_PARTS],
        *[_members(n) for n in plan.MEMBER_PARTS],
        *[Stage(n, _TRACED, _traced(k), lambda s: run.depth) for k, n in enumerate(("traces", "evidence", "entities"))],
        Stage("candidates", ("evidence", "entities", "rna", "aligned", "protein", "metabolite"), lambda r, s: plan.ranked(r.layers(_names(s)), r.store.table("entities"), r.store.table("evidence")), whole=True),
    ]
    return [Stage(s.name, s.needs, s.build, lambda x, p=correlations[s.name]: p, s.whole) if s.name in correlations else s for s in out]


def stale(run: Run, stage: Stage) -> dict[str, str]:
    """The strains whose rows of a stage aren't up to date, with the versions to make; ALL stands for a whole stage."""
    wanted = {s.name: run.version(stage, s) for s in run.strains}
    if stage.whole:
        wanted = {ALL: digest(stage.name, sorted(wanted.items()))}
    known = run.store.versions(stage.name)
    return {s: v for s, v in wanted.items() if known.get(s) != v}


def advance(run: Run, until: str | None = None) -> dict[str, list[str]]:
    """Makes what isn't up to date, stage by stage, and returns what was made: stage -> strains. Ends after the stage until, if one is named."""
    made: dict[str, list[str]] = {}
    by_name = {s.name: s for s in run.strains}
    for stage in stages(run):
        gone = [s for s in run.store.versions(stage.name) if s != ALL and s not in by_name]
        if gone:
            run.store.forget(stage.name, gone)
        todo = stale(run, stage)
        if todo:
            with timed(run.spark, stage.name, run.seconds):
                run.store.put(stage.name, stage.build(run, list(by_name.values()) if stage.whole else [by_name[s] for s in todo]), todo)
            made[stage.name] = sorted(todo)
        if stage.name == until:
            break
    return made
