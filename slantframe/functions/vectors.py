"""Three-vectors of Columns, so that geometry reads as algebra and stays in generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vec:
    """A vector whose components are Columns."""

    x: Column
    y: Column
    z: Column

    @classmethod
    def of(cls, prefix: str) -> Vec:
        """The columns prefix_x, prefix_y and prefix_z."""
        return cls(F.col(f"{prefix}_x"), F.col(f"{prefix}_y"), F.col(f"{prefix}_z"))

    @classmethod
    def literal(cls, x: float, y: float, z: float) -> Vec:
        return cls(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    __rmul__ = __mul__

    def __neg__(self) -> Vec:
        return Vec(-self.x, -self.y, -self.z)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        """The unit vector; null for the zero vector."""
        n = F.nullif(self.norm(), F.lit(0.0))
        return Vec(self.x / n, self.y / n, self.z / n)

    def columns(self, prefix: str) -> list[Column]:
        return [self.x.alias(f"{prefix}_x"), self.y.alias(f"{prefix}_y"), self.z.alias(f"{prefix}_z")]

    def attach(self, df, prefix: str):
        """df with the components as columns, so that later uses don't repeat the expression."""
        return df.withColumns({f"{prefix}_x": self.x, f"{prefix}_y": self.y, f"{prefix}_z": self.z})
