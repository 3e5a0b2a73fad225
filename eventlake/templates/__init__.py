"""Provider templates: resources, manifests, cache, rendering."""
