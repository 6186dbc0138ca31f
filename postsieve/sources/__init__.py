"""postsieve.sources"""
