"""fitledger: Spark jobs that turn extracted approval records into an audited,
searchable parts-to-vehicle table."""

__version__ = "0.1.0"
