"""scorelake: evaluation of language-model outputs as Spark jobs."""
