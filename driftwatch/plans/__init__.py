"""Plans: the query registry, oracle SQL, findings and the suite runner."""
