"""Specifications of several distances, built in Python or read from XML, applied in one pass."""

from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compare, encodings


@dataclass(frozen=True)
class Distance:
    """A geometric distance (length 0), or a distance of strings of `length`-character tokens made of features."""

    type: str
    length: int = 0
    features: tuple[str, ...] = ()

    def name(self) -> str:
        return f"{self.type}: {', '.join(self.features)}" if self.features else self.type


@dataclass(frozen=True)
class DistanceSpec:
    distances: tuple[Distance, ...]
    id: str = ""
    extra: dict = field(default_factory=dict, compare=False)

    def names(self) -> list[str]:
        return [d.name() for d in self.distances]

    def to_xml(self) -> str:
        root = ElementTree.Element("group", {"id": self.id} if self.id else {})
        for d in self.distances:
            node = ElementTree.SubElement(root, "distance", {"type": d.type, "length": str(d.length)})
            for f in d.features:
                ElementTree.SubElement(node, "feature", {"type": f})
        return ElementTree.tostring(root, encoding="unicode")

    @classmethod
    def from_xml(cls, text: str) -> "DistanceSpec":
        root = ElementTree.fromstring(text)
        if root.tag != "group":
            raise ValueError("a specification is a group of distances")
        found = []
        for node in root.findall("distance"):
            if "type" not in node.attrib or "length" not in node.attrib:
                raise ValueError("a distance needs a type and a length")
            length = int(node.attrib["length"])
            found.append(Distance(node.attrib["type"], length, tuple(f.attrib["type"] for f in node.findall("feature")) if length else ()))
        return cls(tuple(found), root.attrib.get("id", ""))

    @classmethod
    def read(cls, path: str) -> "DistanceSpec":
        """From an XML file."""
        with open(path, encoding="utf-8") as f:
            return cls.from_xml(f.read())


def distance(type: str, *features: str, length: int = 0) -> Distance:
    return Distance(type, length, features)


def group(*distances: Distance, id: str = "") -> DistanceSpec:
    return DistanceSpec(distances, id)


def apply(spec: DistanceSpec, db: DataFrame, query: DataFrame, compat: bool = False) -> DataFrame:
    """db with a column for each distance of the specification to the one query row."""
    both = db.crossJoin(F.broadcast(query))
    columns = []
    for d in spec.distances:
        if d.length:
            coded = [encodings.zip_features(F.col(c), d.features) for c in ("pts", "query_pts")]
            value = encodings.string_distance(d.type, *coded, d.length).cast("double")
        else:
            value = compare.distance(d.type, F.col("pts"), F.col("query_pts"), compat)
        columns.append(value.alias(d.name()))
    return both.select(*db.columns, *columns)
