"""Sources: curated facts, Akoma Ntoso, treaty HTML and national XML."""
