"""siftwork.sources"""
