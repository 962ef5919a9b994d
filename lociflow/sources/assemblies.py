"""Public assemblies: what is pinned of each, where their files stand, and which species takes which."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.operators.guards import ContractError

#: The host, and the shape of an accession, whose digits stand in threes.
HOST = "https://ftp.ncbi.nlm.nih.gov/genomes/all"
ACCESSION = r"^(GC[AF])_(\d{3})(\d{3})(\d{3})\.\d+$"


@dataclass(frozen=True)
class Assembly:
    """A pinned assembly; url is given where it does not follow from the accession."""

    species: str
    common_name: str
    identifier: str
    name: str
    tax_id: int
    checksum: str
    url: str | None = None
    size: int | None = None


#: The approved assemblies with the checksums that their hosts publish.
APPROVED = (
    Assembly("Felis catus", "Domestic cat", "GCF_000181335.3", "Felis_catus_9.0", 9685, "55c8869801266af1b1fb13ffa7464209"),
    Assembly("Panthera leo", "Lion", "GCF_018350215.1", "P.leo_Ple1_pat1.1", 9689, "33cb54c850de6090ff6364f3823606ac"),
    Assembly("Panthera tigris", "Amur tiger", "GCF_000464555.1", "PanTig1.0", 74533, "7d373b516c4ae82a1dc9c18bcc1ca389"),
    Assembly("Panthera onca", "Jaguar", "DNAZOO_Panthera_onca_HiC", "Panthera_onca_HiC", 9690, "3b3811dff68a704075cfdceb5fb3f1f4a869d6deda6dced6dd159b6498919229", "https://dnazoo.s3.wasabisys.com/Panthera_onca/Panthera_onca_HiC.fasta.gz", 745_951_926),
    Assembly("Puma concolor", "Puma", "GCF_003327715.1", "PumCon1.0", 9696, "0bbbfb230e807f8601d1017449f71ea5"),
    Assembly("Panthera pardus", "Leopard", "GCF_001857705.1", "PanPar1.0", 9691, "e3e5fa056f33374224d43aeddb673b2d"),
)


@dataclass(frozen=True)
class Asset:
    """A file to have on hand."""

    identifier: str
    url: str
    path: str
    checksum: str
    size: int | None

    @property
    def kind(self) -> str:
        return "md5" if len(self.checksum) == 32 else "sha256"


def directory(accession: Column, name: Column) -> Column:
    """Folder of an accession such as GCF_018350175.1; the row fails on one of another shape."""
    part = lambda i: F.regexp_extract(accession, ACCESSION, i)
    folder = F.concat_ws("/", F.lit(HOST), part(1), part(2), part(3), part(4), F.concat_ws("_", accession, name))
    return F.when(accession.rlike(ACCESSION), folder).otherwise(F.raise_error(F.concat(F.lit("not an accession: "), F.coalesce(accession, F.lit("null")))).cast("string"))


def fasta_url(accession: Column, name: Column, override: Column | None = None) -> Column:
    """Address of an assembly's FASTA file; a given one goes before that of the accession."""
    found = F.concat(directory(accession, name), F.lit("/"), F.concat_ws("_", accession, name), F.lit("_genomic.fna.gz"))
    return found if override is None else F.when(override.isNotNull(), override).otherwise(found)


def registry(spark, assemblies: Iterable[Assembly] = APPROVED) -> DataFrame:
    """The assemblies by identifier, each with the address of its file."""
    rows = [(a.identifier, a.name, a.species, a.common_name, a.tax_id, a.checksum, a.url, a.size) for a in sorted(assemblies, key=lambda a: a.identifier)]
    df = spark.createDataFrame(rows, "identifier string, name string, species string, common_name string, tax_id int, checksum string, given string, size long")
    return df.withColumn("url", fasta_url(F.col("identifier"), F.col("name"), F.col("given"))).drop("given")


def manifest(spark, output: str, assemblies: Iterable[Assembly] = APPROVED, checksums: Mapping[str, str] = {}) -> list[Asset]:
    """Files of the assemblies, by identifier; checksums replace the pinned ones, and none may be empty."""
    got = [Asset(r.identifier, r.url, f"{output}/reference/{r.identifier}.fna.gz", checksums.get(r.identifier, r.checksum), r.size) for r in registry(spark, assemblies).collect()]
    if bare := [a.identifier for a in got if not a.checksum]:
        raise ContractError(f"assets without a checksum: {bare}")
    return got


def paired(species: Mapping[str, str], assets: Iterable[Asset]) -> dict[str, Asset]:
    """The asset of each species, joined on the identifier; a species without one fails."""
    of = {a.identifier: a for a in assets}
    if missing := sorted(s for s, i in species.items() if i not in of):
        raise ContractError(f"species without an approved assembly: {missing}")
    return {s: of[i] for s, i in species.items()}


def totals(verified: DataFrame) -> DataFrame:
    """Files, bytes, and how many are verified, wrong or absent, of what `tables.verify` found."""
    here = F.col("size").isNotNull()
    return verified.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if("verified").alias("verified"), F.count_if(here & ~F.col("verified")).alias("wrong"), F.count_if(~here).alias("absent"))
