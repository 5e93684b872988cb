"""Operations of a training-data pipeline over text tables; nothing outside imports this subpackage."""
