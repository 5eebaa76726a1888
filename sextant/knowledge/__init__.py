"""Knowledge packs: reference tables and rules, and how they merge."""
