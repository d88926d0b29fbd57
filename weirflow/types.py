"""Field types, schemas and their enforcement on frames."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, functions as F, types as T

from .errors import SchemaError


class FieldType(Enum):
    STRING = "string"
    INTEGER = "integer"
    LONG = "long"
    FLOAT = "float"
    DOUBLE = "double"
    BOOLEAN = "boolean"
    TIMESTAMP = "timestamp"
    DATE = "date"
    BYTES = "bytes"
    ARRAY = "array"
    MAP = "map"
    ROW = "row"


_PLAIN = {
    FieldType.STRING: T.StringType(), FieldType.INTEGER: T.IntegerType(), FieldType.LONG: T.LongType(), FieldType.FLOAT: T.FloatType(), FieldType.DOUBLE: T.DoubleType(),
    FieldType.BOOLEAN: T.BooleanType(), FieldType.TIMESTAMP: T.TimestampType(), FieldType.DATE: T.DateType(), FieldType.BYTES: T.BinaryType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    field_type: FieldType
    nullable: bool = True
    description: str = ""
    element_type: FieldType | None = None
    key_type: FieldType | None = None
    value_type: FieldType | None = None
    fields: tuple[Field, ...] = ()

    def spark_type(self) -> T.DataType:
        if self.field_type is FieldType.ARRAY:
            return T.ArrayType(_PLAIN[self.element_type or FieldType.STRING])
        if self.field_type is FieldType.MAP:
            return T.MapType(_PLAIN[self.key_type or FieldType.STRING], _PLAIN[self.value_type or FieldType.STRING])
        if self.field_type is FieldType.ROW:
            return T.StructType([f.struct_field() for f in self.fields])
        return _PLAIN[self.field_type]

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type(), self.nullable, {"comment": self.description} if self.description else None)


@dataclass(frozen=True)
class Schema:
    """An ordered list of fields. ``add`` returns a new schema."""

    fields: tuple[Field, ...] = field(default_factory=tuple)

    def add(self, name: str, field_type: FieldType, **more) -> Schema:
        if name in self.field_names():
            raise SchemaError(f"field {name!r} is there already")
        return Schema((*self.fields, Field(name, field_type, **more)))

    @classmethod
    def from_dict(cls, types: dict[str, FieldType]) -> Schema:
        return cls(tuple(Field(n, t) for n, t in types.items()))

    @classmethod
    def from_pairs(cls, pairs: list[tuple[str, FieldType]]) -> Schema:
        return cls(tuple(Field(n, t) for n, t in pairs))

    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def get_field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def column_count(self) -> int:
        return len(self.fields)

    def to_dict_list(self) -> list[dict]:
        return [{"name": f.name, "type": f.field_type.value, "nullable": f.nullable} for f in self.fields]

    def to_struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def enforce(self, df: DataFrame) -> DataFrame:
        """The schema's columns in its order: missing ones null, others dropped, values as they are."""
        return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.spark_type()).alias(f.name) for f in self.fields])


def as_struct(schema: Schema | T.StructType | str | None) -> T.StructType | str | None:
    return schema.to_struct() if isinstance(schema, Schema) else schema
